"""WARC archives: a deterministic sharded writer and a reader that checks what it reads.

Records are cut into shards by ranges of the page id, each of about the same payload bytes, and sorted within
them. The ranges come from a histogram of all ids, so the same table always gives the same files, byte for
byte: dates are a parameter, record ids and all headers and digests are made anew from the record, gzip members
carry no time. A task writes its shard through temporary names, starts a new file when the compressed size
passes the limit, and renames each file when it is complete. The manifest is written last; readers trust only
the files that it lists, so neither a lost executor nor a second attempt leaves wrong records.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensspark.llm.common import landed, prepared, salted, table, work_dir

REVISIT_BYTES = 1000  # fixed value of the contract: smaller payloads are never deduplicated
SHARD_BYTES = 32 << 20  # payload bytes of a shard
ROLL_BYTES = 8 << 20  # compressed bytes after which a file ends
BROADCAST_ROWS = 100_000  # at most so many groups of copies (60 bytes each) are broadcast; more are joined by shuffle
SALTS = 16
BINS = 1 << 14
DATE = "2024-01-01T00:00:00Z"
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, seq int, file string, records long, bytes long, sha1 string, first_id long, last_id long"
ENTRY = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}:{digest}'.encode()).digest())}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record; a revisit (refers_to is set) has the HTTP head but no payload."""
    digest = hashlib.sha1(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest.hexdigest())}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest.digest()).decode()}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='!#$&()*+,/:;=?@[]~%')}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest.hexdigest())}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields; raises if a digest or length does not hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    block = rest[:size]
    if lines[0] != "WARC/1.1" or len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("broken WARC record")
    if fields["WARC-Block-Digest"] != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}":
        raise ValueError("wrong block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
        raise ValueError("wrong payload digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return {
        "page_id": number("X-Page-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload_bytes": length,
        "payload_digest": digest.hex(),
        "payload": payload if kind == "response" else None,
    }


def write(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", payload: str = "html",
          shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write one record per row below ``out`` and commit them with a manifest, which is returned.

    A null payload is empty. Of equal payloads of at least 1000 bytes the largest id is the response; rows that
    repeat this id are responses too, and without any id all are. Null ids come first. An empty table gives an
    empty manifest. Other columns are ignored. A hot payload is reduced by partial sums before it is shuffled.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("body"))
    size = F.octet_length("body").cast("long")
    facts = landed(rows.select("id", size.alias("size"), F.sha1(F.encode("body", "UTF-8")).alias("digest")), "warc-facts")
    copies = landed(
        facts.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n"))
        .where("n > 1 AND last IS NOT NULL").select("digest", "last"), "warc-copies",
    )
    low, high, total = facts.agg(F.min("id"), F.max("id"), F.sum("size")).first()
    low, width = low or 0, max(1, -(-((high or 0) - (low or 0) + 1) // BINS))
    place = F.coalesce((F.col("id").cast("double") - F.lit(float(low))) / F.lit(float(width)) + 1, F.lit(0.0))  # null ids have bin 0
    weights = dict(facts.groupBy(F.floor(place).alias("bin")).agg((F.sum("size") + F.count("*")).alias("w")).collect())  # at most BINS + 1 rows
    shards = max(1, -(-(total or 0) // shard_bytes))
    first, parts, count = _ranges(weights, shards)
    known = lambda values: F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), F.floor(place).cast("int") + 1)
    alone = F.lit(True) if width == 1 else F.col("id").isNull()
    if width > 1 and max(parts[1:], default=1) > 1:  # ids above the mean weight of a shard, so no more than there are shards
        heavy = facts.where(F.col("id").isNotNull() & (known(parts) > 1)).groupBy("id").agg((F.sum("size") + F.count("*")).alias("w"))
        hot = [r.id for r in heavy.where(F.col("w") > sum(weights.values()) / shards).select("id").collect()]
        alone |= F.col("id").isin(hot) if hot else F.lit(False)
    within = F.when(alone, F.pmod(F.xxhash64("id", "url", "body"), known(parts))).otherwise(F.floor((place - F.floor(place)) * known(parts)))
    shard = known(first) + within
    wide = rows.withColumn("digest", F.sha1(F.encode("body", "UTF-8")))
    if copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wide = wide.join(F.broadcast(copies), "digest", "left")
    else:
        spread = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        wide = wide.withColumn("salt", salted("id", SALTS)).join(spread, ["digest", "salt"], "left")
    refers = F.when((size >= REVISIT_BYTES) & (F.col("id").isNull() | (F.col("id") < F.col("last"))), F.col("last"))
    wide = wide.select("id", "url", "body", "digest", refers.alias("refers_to"), shard.cast("int").alias("shard"))
    dealt = wide.repartitionById(count, "shard").sortWithinPartitions("shard", "id", "digest", "url")
    manifest = dealt.drop("digest").mapInArrow(_writer(out, roll_bytes, date), MANIFEST)
    manifest.write.json(f"{out}/manifest")
    return spark.read.schema(MANIFEST).json(f"{out}/manifest")


def _ranges(weights: dict[int, int], shards: int) -> tuple[list[int], list[int], int]:
    """For each bin its first shard and how many shards it is cut into; the shards in all.

    Neighbouring bins share a shard of about the mean weight. A bin above that is cut by the ids' place in it;
    the rows of a hot id, or of none, are dealt to its shards by their hash.
    """
    goal, first, parts, at, filled = max(1, sum(weights.values()) / shards), [], [], 0, 0.0
    for b in range(max(weights, default=0) + 1):
        own = weights.get(b, 0)
        cut = max(1, round(own / goal))
        if filled and (cut > 1 or filled + own / 2 > goal):
            at, filled = at + 1, 0.0
        first.append(at)
        parts.append(cut)
        if cut > 1:
            at += cut
        else:
            filled += own
    return first, parts, at + 1


def _writer(out: str, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(out)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for shard, own in itertools.groupby(rows, key=lambda r: r[4]):
            done: list[dict] = []
            for seq in itertools.count():
                entry = _file(system, base, shard, seq, own, roll_bytes, date)
                if entry is None:
                    break
                done.append(entry)
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())]))

    return run


def _file(system, base: str, shard: int, seq: int, rows: Iterator[tuple], roll_bytes: int, date: str) -> dict | None:
    """Write records until the compressed size passes the limit or the shard ends; None if there is none left."""
    row = next(rows, None)
    if row is None:
        return None
    name = f"shard-{shard:06d}-{seq:05d}.warc.gz"
    temporary = f"{base}/_temporary/{name}.{uuid.uuid4().hex}"
    system.create_dir(f"{base}/_temporary", recursive=True)
    entry = {"shard": shard, "seq": seq, "file": name, "records": 0, "bytes": 0, "first_id": row[0]}
    sha1 = hashlib.sha1()
    with system.open_output_stream(temporary, compression=None) as sink:
        while row is not None:
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            data = packer.compress(record(row[0], row[1], row[2].encode("utf-8", "surrogatepass"), row[3], date)) + packer.flush()
            sink.write(data)
            sha1.update(data)
            entry |= {"records": entry["records"] + 1, "bytes": entry["bytes"] + len(data), "last_id": row[0]}
            row = next(rows, None) if entry["bytes"] < roll_bytes else None
    system.move(temporary, f"{base}/{name}")
    return entry | {"sha1": sha1.hexdigest()}


def read(manifest: DataFrame, out: str, payload: bool = False) -> DataFrame:
    """The records of the files in the manifest; file sizes, counts, hashes and digests are checked.

    Files are read as streams, one record in memory at a time.
    """
    names = ENTRY + (", payload binary" if payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _filesystem(out)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + ([("payload", pa.binary())] if payload else []))
        for batch in batches:
            for entry in batch.to_pylist():
                found, held, count = [], 0, 0
                for fields in _records(system, f"{base}/{entry['file']}", entry):
                    count += 1
                    held += len(fields["payload"] or b"") if payload else 100
                    found.append({k: fields[k] for k in schema.names})
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_pylist(found, schema=schema)
                        found, held = [], 0
                if count != entry["records"]:
                    raise ValueError(f"{entry['file']}: {count} records instead of {entry['records']}")
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return manifest.repartition(max(1, manifest.count())).mapInArrow(run, names)


def _records(system, path: str, entry: dict) -> Iterator[dict]:
    sha1, size = hashlib.sha1(), 0
    with system.open_input_stream(path, compression=None) as source:
        unpacker, data = zlib.decompressobj(31), []
        while chunk := source.read(1 << 20):
            sha1.update(chunk)
            size += len(chunk)
            while chunk:
                data.append(unpacker.decompress(chunk))
                if not unpacker.eof:
                    break
                chunk = unpacker.unused_data
                yield parse(b"".join(data))
                unpacker, data = zlib.decompressobj(31), []
    if size != entry["bytes"] or sha1.hexdigest() != entry["sha1"]:
        raise ValueError(f"{path}: not the file that the manifest lists")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC files, then gives one row per record read back."""
    out = work_dir(prepared(spark), "warc")
    manifest = write(table(spark, sf_dir, "pages", "page_id", "url", "html"), out)
    return read(manifest, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     c AS (SELECT page_id, strlen(body) AS n, sha1(body) AS d, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to
FROM c
"""
