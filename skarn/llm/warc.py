"""WARC archives and their Merkle fixity audit (op 2).

An archive is a file of WARC records, each compressed on its own, so that any record can
be read by its place. Its catalogue has one row a record: number, offset and length in the
uncompressed archive, place and size in the file.

The records of an archive, in the order of their offsets, are the leaves of a tree: a leaf
hashes its record's bytes, a node the hashes and offset ranges of up to :data:`FANOUT`
neighbours. Two replicas are compared from the roots down; only children of nodes that
differ are looked at, until the records that differ are found.

An archive holds a bounded number of records, so one task reads one archive at a time and
builds its whole tree; all levels of all trees are written once.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.shared import new_path, qualified, sized_join, slices, trim, written

#: Ids that share an archive, and children of a node.
ARCHIVE_IDS, FANOUT = 4096, 16
#: Most tasks that archives are dealt to.
MOST_PARTS = 20_000
#: Records have no date of their own in a table of pages (fixed value).
DATE = "1970-01-01T00:00:00Z"

_CATALOGUE = {
    "archive": pa.int64(), "record_no": pa.int64(), "offset": pa.int64(), "length": pa.int64(), "page_id": pa.int64(),
    "dir": pa.string(), "name": pa.string(), "at": pa.int64(), "size": pa.int64(),
}
CATALOGUE = "archive long, record_no long, offset long, length long, page_id long, dir string, name string, at long, size long"
NODES = "replica int, archive long, level int, idx long, hash string, lo long, hi long, page_id long"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_ids: int = ARCHIVE_IDS) -> DataFrame:
    """``archive``, ``page_id``, ``url``, ``data``: a WARC resource record of each row.

    Archives hold consecutive ids. A null URL or content is empty. Rows that repeat an id are
    records of their own; ids with over twice as many rows as an archive should hold, and
    rows without an id, are dealt to as many archives, numbered below 0, as they need.
    """
    page, url, html = F.col(id_col).cast("long"), F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    base = F.floor(page / archive_ids).cast("long")
    counts = pages.groupBy(F.coalesce(base, F.lit(0)).alias("base"), base.isNull().alias("no_id")).agg(F.count("*").alias("n"))
    hot = written(counts.where(F.col("no_id") | (F.col("n") > 2 * archive_ids)).select("base", "no_id", F.ceil(F.col("n") / archive_ids).alias("volumes")), "archive-volumes")
    rows = pages.select(
        F.coalesce(base, F.lit(0)).alias("base"), base.isNull().alias("no_id"), page.alias("page_id"), url.alias("url"),
        F.concat(head, html, F.lit("\r\n\r\n")).cast("binary").alias("data"), F.xxhash64(F.monotonically_increasing_id()).alias("dealt"),
    )
    volume = F.coalesce(F.pmod("dealt", F.col("volumes")), F.lit(0))
    own = -1 - F.pmod(F.xxhash64("base", "no_id", volume), F.lit(2**62))
    archive = F.when(F.col("no_id") | (volume > 0), own).otherwise(F.col("base"))
    return sized_join(rows, hot, ["base", "no_id"], "left").select(archive.alias("archive"), "page_id", "url", "data")


class _Archive:
    """One archive file being written; a lost attempt's file is in no catalogue."""

    def __init__(self, base: str):
        fs, root = pyarrow.fs.FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        self.dir, self.name, self.at = base, f"{uuid.uuid4().hex}.warc.gz", 0
        self.sink = fs.open_output_stream(f"{root}/{self.name}", compression=None)

    def add(self, member: bytes) -> tuple[str, str, int, int]:
        self.sink.write(member)
        self.at += len(member)
        return self.dir, self.name, self.at - len(member), len(member)

    def close(self) -> None:
        self.sink.close()


def packed(data: bytes) -> bytes:
    """A record as a gzip member of its own."""
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def unpacked(member: bytes) -> bytes | None:
    """A record from its gzip member; None where that can't be read."""
    try:
        return zlib.decompress(member, 31)
    except zlib.error:
        return None


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and content of a WARC record; a malformed one is an error."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields.get("content-length", -1))
    if not found or not lines[0].startswith("WARC/1.") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return fields, rest[:size]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CATALOGUE.values(), strict=True)], [*_CATALOGUE])


def write_archives(rows: DataFrame, to: str | None = None) -> DataFrame:
    """Writes :func:`records` to archive files in the order of id, URL and digest; returns their catalogue.

    ``to``: a folder that all executors share (by default one in the cluster's shared folder).
    Records are compressed before they are shuffled to their archives.
    """
    base = qualified(rows.sparkSession, to or new_path(rows.sparkSession, "archives"))

    def compressed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            data = b.column(3).to_pylist()
            made = [pa.array([len(x) for x in data], pa.int64()), pa.array([hashlib.sha256(x).digest() for x in data]), pa.array(map(packed, data), pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *made], ["archive", "page_id", "url", "length", "digest", "member"])
        trim()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, number, offset = None, None, 0, 0
        for b in slices(it):
            made = []
            for archive, page, length, member in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if archive != now:
                    if out:
                        out.close()
                    out, now, number, offset = _Archive(base), archive, 0, 0
                made.append((archive, number, offset, length, page, *out.add(member)))
                number, offset = number + 1, offset + length
            yield _rows(made)
        if out:
            out.close()
        trim()

    parts = dealt(rows.select("archive").distinct().count())
    made = rows.select("archive", "page_id", "url", "data").mapInArrow(compressed, "archive long, page_id long, url string, length long, digest binary, member binary")
    ordered = made.repartition(parts, "archive").sortWithinPartitions("archive", "page_id", "url", "digest")
    return written(ordered.select("archive", "page_id", "length", "member").mapInArrow(batches, CATALOGUE), "archive-catalogue")


def dealt(archives: int) -> int:
    """Parts that archives are dealt to: rows say nothing of what lies behind them, so their number is set here."""
    return min(max(1, archives), MOST_PARTS)


def members(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
    """Catalogue rows, sorted by file and number, each with its bytes, read by place."""
    name, source = None, None
    for b in it:
        for r in b.to_pylist():
            if r["name"] != name:
                if source:
                    source.close()
                fs, root = pyarrow.fs.FileSystem.from_uri(r["dir"])
                name, source = r["name"], fs.open_input_file(f"{root}/{r['name']}")
            source.seek(r["at"])
            yield r, source.read(r["size"])
    if source:
        source.close()


def by_file(catalogue: DataFrame) -> DataFrame:
    parts = dealt(catalogue.select("name").distinct().count())
    return catalogue.repartition(parts, "name").sortWithinPartitions("name", "record_no")


def replicated(catalogue: DataFrame, edit: Callable[[int | None, bytes], bytes | None], to: str | None = None) -> DataFrame:
    """A replica of archives, and its catalogue. ``edit`` gives what becomes of an id's record; None: its place holds zeros."""
    base = qualified(catalogue.sparkSession, to or new_path(catalogue.sparkSession, "archives"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, made = None, None, []
        for r, member in members(it):
            if r["name"] != now:
                if out:
                    out.close()
                out, now = _Archive(base), r["name"]
            data = unpacked(member)
            new = edit(r["page_id"], data)
            member = bytes(len(member)) if new is None else member if new == data else packed(new)
            made.append((*(r[c] for c in ("archive", "record_no", "offset", "length", "page_id")), *out.add(member)))
            if len(made) == 1000:
                yield _rows(made)
                made = []
        if out:
            out.close()
        if made:
            yield _rows(made)
        trim()

    return written(by_file(catalogue).mapInArrow(batches, CATALOGUE), "archive-catalogue")


def damaged_copy(catalogue: DataFrame) -> DataFrame:
    """A replica for tests of the audit: the records of some ids have another first byte, those of some others are lost."""

    def edit(page: int | None, data: bytes) -> bytes | None:
        if page is not None and page % 211 == 5:
            return None
        return b"X" + data[1:] if page is not None and page % 97 == 13 else data

    return replicated(catalogue, edit)


def read_archives(catalogue: DataFrame) -> DataFrame:
    """``archive``, ``record_no``, ``url``, ``record_id``, ``content`` of all records, from the files; a record that can't be read has nulls."""
    names = ["archive", "record_no", "url", "record_id", "content"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, member in members(it):
            try:
                fields, content = parsed(unpacked(member) or b"")
            except ValueError:
                fields, content = {}, None
            row = (r["archive"], r["record_no"], fields.get("warc-target-uri"), fields.get("warc-record-id"), content)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    return by_file(catalogue).mapInArrow(batches, "archive long, record_no long, url string, record_id string, content binary")


def trees(catalogue: DataFrame, replica: int, height: int, fanout: int = FANOUT) -> DataFrame:
    """Nodes of all levels, 0 (records) to ``height``, of the trees of all archives; a record that can't be read has none."""
    names = ["replica", "archive", "level", "idx", "hash", "lo", "hi", "page_id"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def nodes(archive: int, leaves: list[tuple]) -> pa.RecordBatch:
        out, level = [(replica, archive, 0, *x) for x in leaves], [x[:4] for x in leaves]
        for k in range(1, height + 1):
            above: dict[int, list[tuple]] = {}
            for x in level:
                above.setdefault(x[0] // fanout, []).append(x)
            level = [(i, hashlib.sha256("\n".join(":".join(map(str, c)) for c in own).encode()).hexdigest(), own[0][2], own[-1][3]) for i, own in above.items()]
            out += [(replica, archive, k, *x, None) for x in level]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaves = None, []
        for r, member in members(it):
            if (r["name"], r["archive"]) != now:
                if leaves:
                    yield nodes(now[1], leaves)
                now, leaves = (r["name"], r["archive"]), []
            if (data := unpacked(member)) is not None:
                leaves.append((r["record_no"], hashlib.sha256(data).hexdigest(), r["offset"], r["offset"] + r["length"], r["page_id"]))
        if leaves:
            yield nodes(now[1], leaves)
        trim()

    return by_file(catalogue).mapInArrow(batches, NODES)


def audit(original: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records in which ``replica`` differs: ``archive``, ``record_no``, ``offset``, ``length``, ``page_id``, ``expected_sha256``, ``actual_sha256``.

    Both are catalogues of archives (:func:`write_archives`), whose files are read. A digest is
    null where a replica has no such record, or it can't be read; place and id are the
    original's, or the replica's where only that has the record. Equal or empty replicas give none.
    """
    most = max(x.agg(F.coalesce(F.max("record_no"), F.lit(0))).first()[0] for x in (original, replica)) + 1
    height = 0
    while fanout**height < most:
        height += 1
    nodes = written(trees(original, 0, height, fanout).unionByName(trees(replica, 1, height, fanout)), "merkle-nodes")
    each = lambda c, k: F.max(F.when(F.col("replica") == k, F.col(c)))
    suspects = None
    for level in range(height, -1, -1):
        near = nodes.where(F.col("level") == level)
        if suspects is not None:
            near = near.withColumn("above", F.floor(F.col("idx") / fanout).cast("long")).join(suspects.withColumnRenamed("idx", "above"), ["archive", "above"], "left_semi")
        both = near.groupBy("archive", "idx").agg(*(each(c, k).alias(f"{c}_{k}") for c in ("hash", "lo", "hi", "page_id") for k in (0, 1)))
        same = [F.col(f"{c}_0").eqNullSafe(F.col(f"{c}_1")) for c in ("hash", "lo", "hi")]
        found = both.where(~(same[0] & same[1] & same[2]))
        suspects = found.select("archive", "idx")
    either = lambda c: F.when(F.col("hash_0").isNotNull(), F.col(f"{c}_0")).otherwise(F.col(f"{c}_1"))
    return found.select(
        "archive", F.col("idx").alias("record_no"), either("lo").alias("offset"), (either("hi") - either("lo")).alias("length"), either("page_id").alias("page_id"),
        F.col("hash_0").alias("expected_sha256"), F.col("hash_1").alias("actual_sha256"),
    )
