"""Word lists of the question language."""

from __future__ import annotations

#: Words that carry no schema meaning. Quantifiers and positions that change a query are not among them.
STOPWORDS = frozenset(
    """
    a an the this that these those i me my we our you your he him his she her it its they them their
    am is are was were be been being do does did doing have has had having can could will would shall should may might must
    and or but if because as until while of at by for with about against into through during to from up down in out on off
    again further then once here there when where why how what which who whom whose any both few other some such own same so
    than too very just now also please tell give get let us there's
    """.split()
)
#: Words that never are a value in a question, beside the stopwords.
NOT_VALUES = frozenset(
    """
    show list display find fetch return see view count number many much total sum average mean avg minimum maximum min max
    lowest highest smallest largest biggest cheapest earliest latest newest oldest first last top bottom most least more less
    all each every no not without none only exist exists existing available record records row rows entry entries item items
    value values field fields column columns table tables detail details info information data date dates time name names id ids
    amount quantity percentage limit order sort sorted group grouped per between before after above below over under greater
    equal equals exactly same different empty null missing set under belong belongs belonging related associated respective
    category kind type recent current
    """.split()
)
#: Words that announce a value for the nearest entity.
INTRODUCERS = frozenset({"named", "called", "name", "titled", "labelled", "labeled"})
#: Words between an entity and its value that are passed over.
CONNECTIVES = frozenset("in of for from by at on under within inside to with belonging belongs belong that are is were was which who have has".split())
YES, NO = frozenset({"true", "yes", "active", "enabled", "on"}), frozenset({"false", "no", "inactive", "disabled", "off"})
#: A column may be meant by these words too; the key is a word of its name.
THESAURUS = {
    "salary": ("pay", "wage", "earnings", "compensation"),
    "price": ("cost", "rate", "charge"),
    "amount": ("sum", "total"),
    "email": ("mail", "address"),
    "phone": ("telephone", "mobile", "contact"),
    "mobile": ("phone", "cell"),
    "quantity": ("count", "units", "volume"),
    "employee": ("worker", "staff", "personnel"),
    "client": ("customer", "account"),
    "customer": ("client", "buyer"),
    "supplier": ("vendor", "provider"),
    "product": ("item", "goods", "article"),
    "order": ("purchase",),
    "date": ("day",),
    "country": ("nation",),
    "nation": ("country",),
    "region": ("area", "zone", "territory"),
    "company": ("firm", "organization", "business"),
    "organization": ("company", "org", "institution"),
    "active": ("enabled", "live"),
    "enabled": ("active",),
    "balance": ("funds",),
    "discount": ("rebate", "reduction"),
    "status": ("state", "condition"),
    "segment": ("sector",),
    "size": ("dimension",),
    "language": ("lang", "tongue"),
    "created": ("added", "made"),
    "hired": ("employed", "joined"),
    "birth": ("born",),
}
#: Beginnings of run-together identifiers (onlineorders, paymentstatus).
COMPOUND_HEADS = (
    "online offline payment product customer supplier order invoice price user account sale purchase stock tax shipping delivery "
    "item store market event web is has"
).split()
#: Short forms in column names and what they stand for.
ACRONYMS = {
    "acctbal": "account balance", "mktsegment": "market segment", "addr": "address", "qty": "quantity", "amt": "amount", "dob": "date of birth",
    "sku": "stock keeping unit", "vat": "value added tax", "gst": "goods and services tax", "gstin": "goods and services tax number", "pan": "permanent account number",
    "uom": "unit of measure", "eta": "estimated time of arrival", "kyc": "know your customer", "otp": "one time password", "pin": "postal code",
    "url": "web address", "ip": "internet address", "lat": "latitude", "lng": "longitude", "ts": "timestamp", "desc": "description",
    "num": "number", "no": "number", "dept": "department", "mgr": "manager", "emp": "employee", "cust": "customer", "org": "organization",
    "inv": "invoice", "po": "purchase order", "so": "sales order", "hsn": "commodity code", "mrp": "list price", "ref": "reference", "lang": "language",
    "vec": "vector", "conv": "conversation", "doc": "document", "evt": "event", "msg": "message", "cfg": "configuration", "pct": "percentage",
}
#: What else a word of a column name may be called, in annotations.
WORD_SYNONYMS = {
    "name": ("title", "label"), "balance": ("funds",), "quantity": ("amount", "units"), "price": ("cost",), "status": ("state",), "priority": ("urgency",),
    "discount": ("rebate",), "tax": ("duty",), "comment": ("note", "remark"), "phone": ("telephone",), "email": ("mail",), "salary": ("pay", "wage"),
    "size": ("dimension",), "brand": ("make",), "type": ("kind",), "text": ("content",), "term": ("period",), "segment": ("sector",), "total": ("sum",),
    "language": ("tongue",), "value": ("worth",), "url": ("link",), "date": ("day",), "code": ("identifier",), "description": ("details",), "address": ("location",),
}
