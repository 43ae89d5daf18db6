"""WARC archives and a two-level capture index.

Tasks write archives of gzip members, a record each: `response` records with the payload, and `revisit` records without it for
payloads that another record has. The index has a line for each record, sorted by reversed-host URL key and packed into
compressed blocks; a sparse directory beside each part of the index has a block's first key and place. A lookup finds the part and
then the block by binary search, and reads just that block's and the records' byte ranges.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import itertools
import json
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.llm.common import in_parts, keep, workspace
from inkgrid.llm.urls import host_path, reversed_host

#: Index lines of one compressed block.
BLOCK = 3000
#: Bytes of archives that a task reads, about, and of payloads that it gives on at once.
TASK_BYTES, GIVE_BYTES = 64 << 20, 16 << 20
CAPTURE = "key string, url string, id long, digest string, type string, refers_to long, file string, offset long, length long"
PARTS = "first_key string, first_id long, name string, blocks long"
RECORD = "id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_BAD = re.compile(r"[\x00-\x20\x7f]")


def surt(url: Column) -> Column:
    """The canonical key of a URL: reversed host, then what follows the host. Empty for a null URL."""
    host, _ = host_path(url)
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^.*?://[^/?#]*(.*)$", 1)
    return F.when(host == "", F.coalesce(url, F.lit(""))).otherwise(F.concat(reversed_host(host), F.lit(")"), rest))


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member. The page's id, that of the response which a revisit repeats, and the payload's size are in fields
    of our own, which other readers skip."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page, digest)}", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + _BAD.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"X-Payload-Length: {len(payload)}"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """The fields and the payload of one record; checks the payload of a response against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    _, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    if fields["WARC-Type"] == "response" and "sha1:" + base32(hashlib.sha1(payload).hexdigest()) != fields["WARC-Payload-Digest"]:
        raise ValueError(f"damaged payload in record {fields['WARC-Record-ID']}")
    return fields, payload


def _digests(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    html = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("long").alias("bytes"))


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, out: str | None = None, date: str = "1970-01-01T00:00:00Z") -> str:
    """Writes a record for each row, and the index; returns the folder. Of records with equal payloads of at least `least_bytes` bytes, that
    with the smallest id is the response and the others revisit it.

    A null html is an empty payload, a null URL has an empty key. Rows that repeat an id with the same payload are of the same type. Rows
    with a null id are always responses. An empty table gives an index without parts. Further columns are ignored.
    """
    spark = pages.sparkSession
    out = out or workspace(spark, "warc")
    rows = _digests(pages, id_col, url_col, html_col)
    known = keep(rows.select("id", "sha1", "bytes").where(F.col("bytes") >= least_bytes), "warc-digests")
    first = known.groupBy("sha1").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    again = keep(known.join(first, "sha1").where("id > refers_to").select("id", "sha1", "refers_to").distinct(), "warc-revisits")

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(out)
        batches = in_parts(batches)
        if (head := next(batches, None)) is None:
            return
        fs.create_dir(f"{root}/archive", recursive=True)
        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
        with fs.open_output_stream(f"{root}/archive/{name}", compression=None) as f:
            for b in itertools.chain([head], batches):
                found = []
                for i in range(b.num_rows):
                    key, url, page, html, sha1, refers = (b.column(j)[i].as_py() for j in range(6))
                    digest = base32(sha1)
                    member = record(page, url, html.encode("utf-8", "surrogatepass"), digest, refers, date)
                    f.write(member)
                    found.append((key, url, page, digest, "response" if refers is None else "revisit", refers, name, at, len(member)))
                    at += len(member)
                names = ["key", "url", "id", "digest", "type", "refers_to", "file", "offset", "length"]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds, strict=True)], names)

    captures = rows.join(again, ["id", "sha1"], "left").select(surt(F.col("url")).alias("key"), "url", "id", "html", "sha1", "refers_to").mapInArrow(write, CAPTURE)
    captures.write.parquet(f"{out}/captures")
    _write_index(spark.read.schema(CAPTURE).parquet(f"{out}/captures"), out)
    return out


def _write_index(captures: DataFrame, out: str) -> None:
    spark = captures.sparkSession

    def pack(batches):
        fs, root = pafs.FileSystem.from_uri(out)
        lines = (r for b in in_parts(batches) for r in b.to_pylist())
        if (head := next(lines, None)) is None:
            return
        lines, name = itertools.chain([head], lines), uuid.uuid4().hex
        fs.create_dir(f"{root}/index", recursive=True)
        directory, at = [], 0
        with fs.open_output_stream(f"{root}/index/{name}.blocks", compression=None) as f:
            while block := list(itertools.islice(lines, BLOCK)):
                packed = zlib.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in block).encode("utf-8", "surrogatepass"), 6)
                f.write(packed)
                directory.append((block[0]["key"], at, len(packed), len(block)))
                at += len(packed)
        with fs.open_output_stream(f"{root}/index/{name}.directory", compression=None) as f:
            f.write(json.dumps(directory).encode())
        yield pa.RecordBatch.from_pydict({"first_key": [head["key"]], "first_id": pa.array([head["id"]], pa.int64()), "name": [name], "blocks": [len(directory)]})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "id", "file", "offset"]
    sorted_ = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sorted_.mapInArrow(pack, PARTS).write.parquet(f"{out}/parts")


class Index:
    """Reads one index: parts are (first key, name), sorted; a part's directory is read when it is first needed."""

    def __init__(self, path: str, parts: list[tuple[str, str]]):
        self.fs, self.root = pafs.FileSystem.from_uri(path)
        self.firsts, self.names = [[p[i].encode("utf-8", "surrogatepass") if i == 0 else p[i] for p in parts] for i in (0, 1)]
        self.part = self.block = self.archive = (None, None)

    def directory(self, name: str) -> list[tuple[str, int, int, int]]:
        if self.part[0] != name:
            with self.fs.open_input_stream(f"{self.root}/index/{name}.directory", compression=None) as f:
                self.part = name, json.loads(f.read())
        return self.part[1]

    def lines(self, name: str, offset: int, length: int) -> list[dict]:
        if self.block[0] != (name, offset):
            with self.fs.open_input_file(f"{self.root}/index/{name}.blocks") as f:
                raw = f.read_at(length, offset)
            self.block = (name, offset), [json.loads(x) for x in zlib.decompress(raw).decode("utf-8", "surrogatepass").split("\n")]
        return self.block[1]

    def find(self, key: str):
        """The lines with that key. Equal keys may go on over blocks and parts."""
        k = key.encode("utf-8", "surrogatepass")
        for p in range(max(0, bisect.bisect_left(self.firsts, k) - 1), len(self.names)):
            if self.firsts[p] > k:
                return
            blocks = self.directory(self.names[p])
            firsts = [b[0].encode("utf-8", "surrogatepass") for b in blocks]
            for first, (_, offset, length, _) in itertools.islice(zip(firsts, blocks, strict=True), max(0, bisect.bisect_left(firsts, k) - 1), None):
                if first > k:
                    return
                yield from (x for x in self.lines(self.names[p], offset, length) if x["key"] == key)

    def record(self, file: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        if self.archive[0] != file:
            if self.archive[1]:
                self.archive[1].close()
            self.archive = file, self.fs.open_input_file(f"{self.root}/archive/{file}")
        return parse(self.archive[1].read_at(length, offset))


def _parts(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """A row for each part of the index, in their order: as many as shuffle partitions at most. Equal keys may fill several parts, by id, null first."""
    rows = spark.read.schema(PARTS).parquet(f"{path}/parts").select("first_key", "first_id", "name").collect()
    order = sorted(rows, key=lambda r: (r[0].encode("utf-8", "surrogatepass"), r[1] is not None, r[1] or 0))
    return [(r[0], r[2]) for r in order]


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate(kinds)], names)


def _row(fields: dict[str, str]) -> tuple:
    number = lambda k: int(fields[k]) if k in fields else None
    return number("X-Page-ID"), number("X-Payload-Length"), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], number("X-Refers-To-Page-ID")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of all records: index blocks give the records' places, and these are read archive by archive, in order. Rows without an id or a URL come back
    without them, rows that repeat as often as they were written; an empty set of archives gives an empty table. A damaged payload is an error."""

    def unpack(batches):
        index = Index(path, [])
        for b in batches:
            for name in b.column(0).to_pylist():
                for _, offset, length, _ in index.directory(name):
                    lines = index.lines(name, offset, length)
                    yield pa.RecordBatch.from_pydict({k: [x[k] for x in lines] for k in ("file", "offset", "length")}, pa.schema({"file": pa.string(), "offset": pa.int64(), "length": pa.int64()}))

    def read(batches):
        index = Index(path, [])
        for b in in_parts(batches):
            yield _rows([_row(index.record(*r)[0]) for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)])

    places = spark.read.schema(PARTS).parquet(f"{path}/parts").select("name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name").mapInArrow(unpack, "file string, offset long, length long")
    # an archive's records in runs of a megabyte, so that its reading can be shared; as many tasks as the archives' bytes ask for
    total = spark.read.schema(CAPTURE).parquet(f"{path}/captures").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    return places.withColumn("run", F.floor(F.col("offset") / (1 << 20))).repartition(tasks, "file", "run").sortWithinPartitions("file", "offset").select("file", "offset", "length").mapInArrow(read, RECORD)


def lookup(urls: DataFrame, path: str, url_col: str = "url") -> DataFrame:
    """(url, id, payload): for each row of urls all captures of that URL (by canonical key), with payloads; a revisit's is that of
    the response it refers to where that has the same key, else null.

    Null and empty URLs have the empty key, and find the captures without a URL; rows that repeat get their captures each; unknown URLs and an empty table give nothing.
    Payloads are read and given on one after the other, so a URL may have any number of captures.
    """
    spark = urls.sparkSession
    parts = _parts(spark, path)

    def find(batches):
        index, found, held = Index(path, parts), [], 0
        for b in in_parts(batches):
            for url, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                responses = {}  # places only
                for x in index.find(key):  # responses come before those that revisit them: lines are sorted by key and id
                    if x["type"] == "response":
                        responses[x["id"]] = x
                    source = responses.get(x["id"] if x["type"] == "response" else x["refers_to"])
                    body = index.record(source["file"], source["offset"], source["length"])[1] if source else None
                    found.append((url, x["id"], body))
                    held += len(body or b"") + 64
                    if held > GIVE_BYTES:
                        yield _found(found)
                        found, held = [], 0
        yield _found(found)

    keyed = urls.select(F.col(url_col).alias("url"), surt(F.col(url_col)).alias("key"))
    return keyed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key").mapInArrow(find, "url string, id long, payload binary")


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["url", "id", "payload"])
