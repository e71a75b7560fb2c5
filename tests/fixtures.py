"""Small catalogs with rows."""

from datetime import date

from askframe.sources.catalog import Catalog


def catalog(**tables):
    """table = ["name type [pk] [>T.c] [| synonym, ...]", ...]"""
    out = []
    for name, columns in tables.items():
        cs = []
        for line in columns:
            left, _, also = line.partition(" | ")
            left, _, fk = left.partition(" >")
            words = left.split()
            pk = words[-1] == "pk"
            cs.append({"name": words[0], "type": " ".join(words[1 : len(words) - pk]), "pk": pk, "fk": fk or None, "synonyms": [s.strip() for s in also.split(",") if s.strip()]})
        out.append({"name": name, "columns": cs})
    return Catalog.from_dict({"database": "t", "tables": out})


FLEET = catalog(
    Client=["id uuid pk", "name string", "email string", "enabled boolean", "createdAt timestamptz", "OrganizationId uuid >Organization.id"],
    Organization=["id uuid pk", "name string"],
    Employee=["id uuid pk", "name string", "clientId uuid >Client.id", "salary numeric", "active boolean | enabled", "hiredAt date"],
    User=["id uuid pk", "name string", "OrganizationId uuid >Organization.id"],
)
SHOP = catalog(
    categories=["id integer pk", "name string", "parent_id integer"],
    products=["id integer pk", "name string", "category_id integer >categories.id", "price numeric"],
    orphan=["id integer pk", "label string"],
)
FLAGS = catalog(
    products=["id integer pk", "name string", "category string", "supplier string", "warranty integer", "isservice boolean", "isscale boolean", "isconstant boolean", "hasdiscount boolean", "pricesell numeric"],
    onlineorders=["id bigint pk", "orderId string", "paymentStatus string"],
)

SHOP_ROWS = {
    "categories": ([(1, "Veg Pizza", None), (2, "Drinks", None), (3, None, 1)], "id int, name string, parent_id int"),
    "products": ([(1, "50% off", 1, 9.5), (2, "5000", 1, 7.0), (3, "foo_bar", 2, 2.5), (4, "fooXbar", 2, 2.5), (5, "Margherita", 1, None)], "id int, name string, category_id int, price double"),
    "orphan": ([], "id int, label string"),
}
FLEET_ROWS = {
    "Organization": ([("o1", "Swaraj"), ("o2", "Acme")], "id string, name string"),
    "Client": ([("c1", "North", "n@x", True, None, "o1"), ("c2", "South", None, False, None, "o2")], "id string, name string, email string, enabled boolean, createdAt timestamp, OrganizationId string"),
    "Employee": (
        [("e1", "John", "c1", 10.0, True, date(2020, 1, 1)), ("e2", "Ann", "c1", 30.0, False, date(2021, 5, 5)), ("e3", "Joe", "c2", 20.0, True, None)],
        "id string, name string, clientId string, salary double, active boolean, hiredAt date",
    ),
    "User": ([("u1", "A", "o1"), ("u2", "B", "o1"), ("u3", "C", "o2")], "id string, name string, OrganizationId string"),
}


def frames(spark, rows):
    return {name: spark.createDataFrame(data, schema) for name, (data, schema) in rows.items()}
