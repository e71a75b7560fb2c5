"""WARC archives with Zstandard: one frame per record, the dictionary in a leading skippable frame.

The dictionary frame has the magic number 0x184D2A5D, four bytes of length, then the dictionary (itself plain or one
Zstandard frame). All record frames after it are compressed with it. Payloads that
occur again are written as revisits of the record that holds them.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askframe.llm.common import free_name, written

#: Fixed values of the formats.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: An archive ends after so many bytes before compression, or so many records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 16 << 20, 4096
#: The dictionary is trained on this many first records of its archive, each up to so many bytes.
TRAINING_RECORDS, TRAINING_BYTES, DICTIONARY_BYTES = 64, 8192, 16 << 10


#: A payload with more copies than this is not dealt by its digest.
HOT_COPIES = 512
#: Bytes of an archive that a frame is fed at first, and at most, at a time.
FIRST_STEP, LAST_STEP = 4096, 1 << 20


def digest(payload: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A response record with the payload, or a revisit with the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The bytes of a ``.warc.zst`` file. Too few or too small records to train on: no dictionary frame."""
    samples = [r[:TRAINING_BYTES] for r in records[:TRAINING_RECORDS]]
    try:
        words = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8) if len(samples) >= 8 else None
    except zstandard.ZstdError:
        words = None
    out = []
    if words is not None:
        data = zstandard.ZstdCompressor().compress(words.as_bytes())
        out.append(struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data)
    packer = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=True, write_content_size=True)
    out += [packer.compress(r) for r in records]
    return b"".join(out)


def read_archive(data: bytes, name: str = "archive") -> Iterator[dict]:
    """The records of an archive, each validated in what it says: headers, lengths, digests. A fault raises ValueError with the place.

    An HTTP length and a payload digest are optional, names of headers have no case, a chunked body comes without its chunks' lengths, and
    records but responses and revisits over HTTP have no payload. Time is in proportion to the bytes. Yields ``type``, ``record_id``, ``url``, ``date``, ``payload`` (None for a revisit), ``payload_bytes``, ``payload_digest``, ``refers_to``.
    """

    def fault(what: str) -> ValueError:
        return ValueError(f"{name}, byte {at}: {what}")

    at, words = 0, None
    view = memoryview(data)
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise fault("the dictionary frame is cut off")
        raw = bytes(view[8 : 8 + size])
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        words, at = zstandard.ZstdCompressionDict(raw), 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=words)
    while at < len(data):
        # the frame's end shows while it is fed, so no frame sees more than a step of what follows it
        one, whole, end, step = unpacker.decompressobj(), [], at, FIRST_STEP
        try:
            while not one.eof and end < len(data):
                whole.append(one.decompress(view[end : end + step]))
                end = min(end + step, len(data))
                step = min(2 * step, LAST_STEP)
        except zstandard.ZstdError as e:
            raise fault(f"not a frame: {e}") from e
        if not one.eof:
            raise fault("the frame is cut off")
        yield _parse(b"".join(whole), fault)
        at = end - len(one.unused_data)


def _headers(lines: list[bytes], fault) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a blank continues the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        if not colon or not key.strip():
            raise fault(f"not a header: {line[:40]!r}")
        name = key.strip().lower().decode("utf-8", "replace")
        out[name] = value.strip().decode("utf-8", "replace")
    return out


def _unchunked(payload: bytes) -> bytes | None:
    """The content of a chunked body; None if it is not one."""
    out, at = [], 0
    while True:
        line = payload.find(b"\r\n", at)
        try:
            n = int(payload[at:line].split(b";")[0], 16) if line >= 0 else -1
        except ValueError:
            return None
        if n < 0 or line + 2 + n > len(payload):
            return None
        if n == 0:
            return b"".join(out)
        out.append(payload[line + 2 : line + 2 + n])
        at = line + 2 + n + 2


def _matches(named: str, payload: bytes) -> bool:
    """Whether a labelled digest is the payload's, in base32 or hex; labels of unknown algorithms are not checked."""
    label, _, value = named.partition(":")
    if label.lower().replace("-", "") not in ("sha1", "sha256", "md5"):
        return True
    raw = hashlib.new(label.lower().replace("-", ""), payload).digest()
    return value.rstrip("=").upper() == base64.b32encode(raw).decode().rstrip("=") or value.lower() == raw.hex()


def _parse(whole: bytes, fault) -> dict:
    head, gap, rest = whole.partition(b"\r\n\r\n")
    first, *fields = head.split(b"\r\n")
    if not gap or first not in (b"WARC/1.0", b"WARC/1.1"):
        raise fault(f"not a WARC record: {first[:40]!r}")
    h = _headers(fields, fault)
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in h:
            raise fault(f"no {key}")
    size = h["content-length"]
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[int(size) :] != b"\r\n\r\n":
        raise fault(f"the block is not {size} bytes")
    block = rest[: int(size)]
    out = {"type": h["warc-type"], "record_id": h["warc-record-id"], "url": h.get("warc-target-uri"), "date": h["warc-date"], "refers_to": h.get("warc-refers-to"), "payload": None, "payload_bytes": None, "payload_digest": None}
    named = h.get("warc-payload-digest")
    if out["type"] in ("response", "revisit") and h.get("content-type", "application/http").lower().startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap or not http.startswith(b"HTTP/"):
            raise fault("no HTTP header")
        fields = _headers(http.split(b"\r\n")[1:], fault)
        said = fields.get("content-length")
        if said is not None and not said.isdigit():
            raise fault(f"not a length: {said[:40]!r}")
        chunked = "chunked" in fields.get("transfer-encoding", "").lower()
        if out["type"] == "response":
            if said is not None and not chunked and int(said) != len(payload):
                raise fault(f"the payload has {len(payload)} bytes, not {said}")
            content = _unchunked(payload) if chunked else None
            if named and not _matches(named, payload) and not (content is not None and _matches(named, content)):
                raise fault("the payload does not match its digest")
            out["payload"] = payload if content is None else content
            out["payload_bytes"] = len(out["payload"])
            named = named or "sha1:" + digest(out["payload"])
        elif payload or not (out["refers_to"] or h.get("warc-refers-to-target-uri")):
            raise fault("a revisit has no payload and names its record")
        else:
            out["payload_bytes"] = int(said) if said is not None else None
        out["payload_digest"] = named.removeprefix("sha1:") if named else None
    return out


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", keep: str = "max", least_bytes: int = 0) -> DataFrame:
    """Archives of all rows: ``name`` string, ``content`` binary, ``n_records``.

    Of rows with equal payloads of at least ``least_bytes``, the one with the largest id (``keep="min"``: the smallest) is a
    response, the others revisit it; rows that repeat that id are responses too. A null html is an empty payload, a null
    url leaves out its header, a null id is smaller than any other. Archives hold at most ``ARCHIVE_RECORDS``
    records and are a bounded row each, so Spark's own writers can store them wherever it can write.
    """
    sha, size, best, rev, dup, top, key = free_name(pages, "sha", "size", "best", "revisit", "dup", "top", "key")
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    x = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    x = x.withColumn(sha, F.sha1(F.encode("html", "UTF-8"))).withColumn(size, F.octet_length("html"))
    agg = F.max("page_id") if keep == "max" else F.min("page_id")
    seen = written(x.where(F.col(size) >= least_bytes).groupBy(sha).agg(agg.alias(best), F.count(F.lit(1)).alias(dup)).where(F.col(dup) > 1))
    # payloads with very many copies are few, at most a row in HOT_COPIES, and go first; their rows then go on with keys of their own, dealt over many tasks
    x = x.join(seen.where(F.col(dup) > HOT_COPIES).select(sha, F.col(best).alias(top)), sha, "left")
    x = x.withColumn(key, F.when(F.col(top).isNull(), F.col(sha)).otherwise(F.concat(sha, F.lit("/"), F.pmod(F.xxhash64("page_id", "url"), F.lit(1024)).cast("string"))))
    x = x.join(seen.where(F.col(dup) <= HOT_COPIES).select(F.col(sha).alias(key), best), key, "left").withColumn(best, F.coalesce(best, top))
    x = x.withColumn(rev, F.col(best).isNotNull() & (F.col(size) >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col(best)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        total = 0

        def close() -> pa.RecordBatch:
            data = archive(held)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(data).hexdigest() + ".warc.zst"]), pa.array([data], pa.binary()), pa.array([len(held)], pa.int64())], ["name", "content", "n_records"])

        for batch in batches:
            for i, u, t, b, r in zip(*(batch.column(c) for c in range(5))):
                one = record(i.as_py(), u.as_py(), t.as_py().encode(), b.as_py(), r.as_py())
                held.append(one)
                total += len(one)
                if total >= ARCHIVE_BYTES or len(held) >= ARCHIVE_RECORDS:
                    yield close()
                    held, total = [], 0
        if held:
            yield close()

    return x.select("page_id", "url", "html", best, rev).mapInArrow(pack, "name string, content binary, n_records long")


def read_archives(archives: DataFrame, name_col: str = "name", content_col: str = "content") -> DataFrame:
    """The records of archives (rows of a name and its bytes, as from ``spark.read.format("binaryFile")`` or :func:`write_archives`)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows: list[dict] = []
                held = 0
                for r in read_archive(memoryview(content.as_buffer()).tobytes(), name.as_py() or "archive"):
                    rows.append(r)
                    held += len(r["payload"] or b"")
                    if len(rows) >= 512 or held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string())])
    src = archives.select(name_col, content_col)
    return src.mapInArrow(unpack, "record_id string, type string, url string, date string, payload binary, payload_bytes long, payload_digest string, refers_to string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Records read back from archives that were written to the shared folder."""
    return read_archives(written(write_archives(pages)))
