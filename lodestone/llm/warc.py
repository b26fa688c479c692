"""WARC archives and Merkle fixity audits of their replicas.

Records are laid out in files with ordered offset ranges. Hashes of records form, sixteen at a time, the hashes of wider
ranges up to one root for each file and one for the archive. Two replicas are compared from the root: only children of
branches that differ are read and compared further, down to records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import written

FAN = 16


def record_text(uri: Column, body: Column, record_id: Column) -> Column:
    """A WARC/1.0 record of type ``resource`` around a text body; its length is counted in octets."""
    body = F.coalesce(body, F.lit(""))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.0"), F.lit("WARC-Type: resource"), F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(uri, F.lit(""))), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    )
    return F.concat(head, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def write_warc(records: DataFrame, path: str, record_col: str = "record") -> None:
    """One uncompressed WARC file for each partition."""
    records.select(F.expr(f"substring({record_col}, 1, length({record_col}) - 4)").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def members(content: bytes) -> Iterator[bytes]:
    """What a file holds, as it is or, if it is gzip, one member after the other."""
    if not content.startswith(b"\x1f\x8b"):
        yield content
    while content.startswith(b"\x1f\x8b"):
        one = zlib.decompressobj(31)
        yield one.decompress(content)
        content = one.unused_data


def parsed(content: bytes) -> Iterator[tuple]:
    """The records of a file: header fields, body and whether it is whole. The length that a header promises decides where a
    body ends, whatever the body holds; without one the record ends before the next line ``WARC/1``."""
    left = b""
    for part in members(content):
        data, at = left + part, 0
        left = b""
        while (at := data.find(b"WARC/1.", at)) >= 0:
            end = data.find(b"\r\n\r\n", at)
            head = data[at : end if end >= 0 else len(data)]
            fields = dict(reversed([(k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])]))
            length = fields.get(b"content-length", b"")
            length = int(length) if length.isdigit() else None
            start = end + 4 if end >= 0 else len(data)
            if length is not None:
                stop = start + length
            else:
                stop = (data.find(b"\r\n\r\nWARC/1.", start - 4) + len(data) + 1) % (len(data) + 1)
            body = data[start:stop]
            names = (b"warc-record-id", b"warc-target-uri", b"warc-type")
            yield *((fields[x].decode("utf-8", "replace") if x in fields else None) for x in names), length, body.decode("utf-8", "replace"), end >= 0 and length == len(body)
            at = min(max(stop, start), len(data))


def read_warc(spark: SparkSession, path: str, batch_bytes: int = 8_000_000) -> DataFrame:
    """``record_id, uri, type, length, body, whole`` of WARC files, plain or gzip (by members), a task for each file.

    ``length`` is what the header promises and ends the body, so a body may hold lines that read like a header. ``whole`` says
    that the body has that many octets: a truncated record, or one without a length, is not whole. What stands before the
    first record gives no row. Octets that are not UTF-8 become U+FFFD. A file is held by its task; Spark's reader takes
    files of up to 2 GB, which is twice what archives are usually cut to.
    """
    schema = "record_id string, uri string, type string, length long, body string, whole boolean"
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows, size = [], 0
                for row in parsed(b.column("content")[k].as_py()):
                    rows.append(row)
                    size += len(row[4])
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, schema)


def hashed(records: DataFrame, record_col: str = "record") -> DataFrame:
    """``records`` with ``length`` in octets and ``hash`` in place of the record itself, which nothing later moves."""
    return records.withColumn("length", F.octet_length(record_col).cast("long")).withColumn("hash", F.sha2(record_col, 256)).drop(record_col)


def layout(hashes: DataFrame, *, id_col: str = "page_id", per_file: int = 256) -> DataFrame:
    """``hashes`` with ``file, ordinal, offset`` (long): ids in order, ``per_file`` neighbouring ids in a file.

    Records that repeat an id follow each other by hash. Records without an id are dealt to a million files below 0 by hash.
    Columns named as the new ones are replaced.
    """
    file = F.coalesce(F.floor(F.col(id_col) / per_file), -1 - F.pmod(F.xxhash64("hash"), F.lit(1_000_000))).cast("long")
    order = Window.partitionBy("file").orderBy(F.col(id_col).asc_nulls_last(), "hash")
    out = hashes.withColumn("file", file)
    out = out.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))
    return out.withColumn("offset", (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).cast("long"))


def levels(leaves: DataFrame, in_file: int, over_files: int) -> list[DataFrame]:
    """The tree of a replica, leaves first: for each level ``file, node, up_file, up_node, from, to, hash``.

    ``in_file`` steps group sixteen neighbouring ordinals of a file, then ``over_files`` steps sixteen neighbouring files.
    A node's hash covers the hashes and ranges of its children in order; each gathers sixteen at most. Every level is
    written once, and the next is made from it.
    """

    def with_parent(table: DataFrame, level: int) -> DataFrame:
        inner = level < in_file
        up_file = F.col("file") if inner else F.floor(F.col("file") / FAN)
        up_node = F.floor(F.col("node") / FAN) if inner else F.lit(0).cast("long")
        return written(table.select("file", "node", up_file.cast("long").alias("up_file"), up_node.cast("long").alias("up_node"), "from", "to", "hash"), "level")

    ends = [F.col("offset").alias("from"), (F.col("offset") + F.col("length")).alias("to")]
    out = [with_parent(leaves.select("file", F.col("ordinal").alias("node"), *ends, "hash"), 0)]
    for level in range(1, in_file + over_files + 1):
        kids = F.array_sort(F.collect_list(F.struct("file", "node", "from", "to", "hash")))
        text = F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k["from"].cast("string"), k["to"].cast("string"), k["hash"])), ",")
        grouped = out[-1].groupBy(F.col("up_file").alias("file"), F.col("up_node").alias("node")).agg(F.min("from").alias("from"), F.max("to").alias("to"), kids.alias("kids"))
        out.append(with_parent(grouped.select("file", "node", "from", "to", F.sha2(text, 256).alias("hash")), level))
    return out


def steps(width: int) -> int:
    """How many times sixteen nodes must become one to leave a single node."""
    n = 0
    while width > 1:
        width, n = -(-width // FAN), n + 1
    return n


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records in which two replicas differ: ``file, ordinal, offset, length`` (long) and ``problem`` (string).

    ``a`` and ``b`` hold ``file, ordinal, offset, length, hash`` by one layout. ``problem`` is ``changed``, ``missing`` (not in
    ``b``) or ``extra`` (not in ``a``); the range is that of ``a``, for extra ones that of ``b``. A place given twice within a
    replica is compared with each of the other's. Two empty replicas do not differ. Other columns are ignored.

    From the root down, each level reads only children of nodes that differ, so equal branches are left at their top.
    """
    places = a.select("file", "ordinal").unionByName(b.select("file", "ordinal"))
    frame = places.agg(F.max("ordinal").alias("n"), F.min("file").alias("x"), F.max("file").alias("y")).first()
    least = frame["x"] or 0
    depth = steps((frame["n"] or 0) + 1), steps((frame["y"] or 0) - least + 1)
    trees = [levels(t.withColumn("file", F.col("file") - least), *depth) for t in (a, b)]
    suspects = None
    for x, y in zip(reversed(trees[0]), reversed(trees[1]), strict=True):
        if suspects is not None:
            x, y = (t.join(suspects, ["up_file", "up_node"], "left_semi") for t in (x, y))
        left, right = (t.select("file", "node", F.struct("from", "to", "hash").alias(n)) for t, n in ((x, "a"), (y, "b")))
        differ = written(left.join(right, ["file", "node"], "full").where(~F.col("a").eqNullSafe(F.col("b"))), "differ")
        suspects = differ.select(F.col("file").alias("up_file"), F.col("node").alias("up_node"))
    kept = F.coalesce("a", "b")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return differ.select((F.col("file") + least).alias("file"), F.col("node").alias("ordinal"), kept["from"].alias("offset"), (kept["to"] - kept["from"]).alias("length"), problem.alias("problem"))
