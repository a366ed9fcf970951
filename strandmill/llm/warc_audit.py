"""WARC files and their Merkle fixity audit.

A leaf hashes a record's offset, length and digest; the hashes of FANOUT neighbours by offset are hashed
into a node together with the range of offsets that they cover, and so on up to one root for each file.
The replicas' roots are compared, and only nodes below differing ones are looked at, down to the leaves
that differ. Those leaves alone are aligned by digest and identifier, so that a lost or inserted record is
reported as such, and what it shifts as shifted. Every level is a grouping on (file, node) with at most
FANOUT members; an alignment holds one row without bytes for each differing record of a file.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmill.llm.common import few, materialize, named, split_uri, table, work_path

FANOUT = 16
#: Identifiers to a file in the query's replicas.
FILE_RECORDS = 1000
CRLF = "\r\n"
#: Bytes read at a time; how a compressed record begins.
CHUNK, MEMBER = 1 << 16, b"\x1f\x8b\x08"
#: How a record ends.
END = b"\r\n\r\n"
#: Records that a reading task holds at most: so many, or just over so many bytes. Level of the compression.
BATCH_ROWS, BATCH_BYTES, LEVEL = 1000, 4 << 20, 3


def warc_record(uri: Column, payload: Column, key: Column | None = None) -> Column:
    """A WARC/1.0 resource record as text; null uri, payload and key count as empty. Line ends in a uri or
    key are left out."""
    def header(name: str, value: Column) -> list[Column]:
        return [F.lit(f"{CRLF}{name}: "), F.translate(F.coalesce(value, F.lit("")), CRLF, "")]

    payload = F.coalesce(payload, F.lit(""))
    own = header("WARC-Record-ID", F.concat(F.lit("<urn:record:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))) if key is not None else []
    head = [F.lit(f"WARC/1.0{CRLF}WARC-Type: resource"), *own, *header("WARC-Target-URI", uri), F.lit(f"{CRLF}Content-Length: "), F.octet_length(payload).cast("string")]
    return F.concat(*head, F.lit(CRLF * 2), payload, F.lit(CRLF * 2))


class Buffered:
    """Bytes that come in chunks; `at` is the place of the first one held."""

    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.held, self.at = iter(chunks), bytearray(), 0

    def more(self) -> bool:
        chunk = next(self.chunks, None)
        self.held += chunk or b""
        return chunk is not None

    def find(self, what: bytes, start: int) -> int:
        while (k := self.held.find(what, start)) < 0:
            start = max(start, len(self.held) - len(what) + 1)
            if not self.more():
                return -1
        return k

    def reach(self, n: int) -> bool:
        while len(self.held) < n and self.more():
            pass
        return len(self.held) >= n

    def cut(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        self.at += len(out)
        return out


def parse_warc(chunks: Iterable[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers in lower case, record) of the records of a WARC file, one record being held at a
    time. What lies between a damaged record and the next one that can be read is one record without
    headers."""
    data = Buffered(chunks)
    while data.reach(1):
        at, stop, head = data.at, -1, {}
        end = data.find(b"\r\n\r\n", 0) if data.reach(5) and data.held.startswith(b"WARC/") else -1
        if end >= 0:
            lines = data.held[:end].decode("utf-8", "replace").split(CRLF)[1:]
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = head.get("content-length", "")
            stop = end + 4 + int(size) if size.isascii() and size.isdigit() else -1
        if stop >= 0 and data.reach(stop + 4) and data.held[stop : stop + 4] == b"\r\n\r\n":
            yield at, head, data.cut(stop + 4)
        else:
            nxt = data.find(b"\r\n\r\nWARC/", 0)
            yield at, {}, data.cut(nxt + 4 if nxt >= 0 else len(data.held))


def inflated(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes of records compressed one by one (gzip members). A member that can't be inflated comes as far as it goes, and what is left of it,
    up to the next member, as it stands, so that it is a damaged record and not a lost one. Other files pass as they are."""
    rest, member, packed, broken = b"", None, None, False
    for chunk in chunks:
        packed = chunk.startswith(MEMBER) if packed is None else packed
        if not packed:
            yield chunk
            continue
        rest += chunk
        while rest:
            if member is None:
                k = rest.find(MEMBER)
                passed, rest = (rest[:k], rest[k:]) if k >= 0 else (rest[:-2], rest[-2:])
                if passed:
                    yield passed
                if k < 0:
                    break
                if broken:
                    yield END
                member, broken = zlib.decompressobj(31), False
            try:
                out = member.decompress(rest)
            except zlib.error:
                yield rest[:1]
                rest, member, broken = rest[1:], None, True
                continue
            yield out
            rest, member = (member.unused_data, None) if member.eof else (b"", member)
    if member is None and packed and rest:
        yield rest


def compressed(record: Column) -> Column:
    """Each record as a gzip member of its own; null stays null."""

    @F.arrow_udf("binary")
    def member(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for data in pc.cast(batch, pa.binary()).to_pylist():
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.append(None if data is None else pack.compress(data) + pack.flush())
            yield pa.array(out, pa.binary())

    return member(record)


def write_warc(records: DataFrame, file_col: str, order: list[str], record_col: str) -> DataFrame:
    """Writes the records of each file, in order, into a new shared folder; returns file, path, records for
    each file. Records are compressed one by one where they lie, before they travel to their file. A file
    is written by one task, a record being held at a time, under a name of its own for each attempt; only
    files of successful attempts are returned. Null records are left out."""
    folder = work_path(records.sparkSession, "warc")
    system, root = split_uri(folder)
    system.create_dir(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, name, path, n = None, None, None, 0

        def closed() -> pa.RecordBatch:
            target.close()
            return pa.record_batch({"file": pa.array([name], pa.string()), "path": pa.array([path], pa.string()), "records": pa.array([n], pa.int64())})

        system, _ = split_uri(folder)
        for batch in batches:
            for file, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if target is None or file != name:
                    if target is not None:
                        yield closed()
                    name, path, n = file, f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    target = system.open_output_stream(split_uri(path)[1], compression=None)
                target.write(record)
                n += 1
        if target is not None:
            yield closed()

    keys = [named(c).alias(f"o{k}") for k, c in enumerate(order)]
    rows = records.filter(named(record_col).isNotNull()).select(named(file_col).cast("string").alias("file"), compressed(named(record_col)).alias("member"), *keys)
    rows = rows.repartition("file").sortWithinPartitions("file", *[f"o{k}" for k in range(len(order))])
    written = rows.select("file", "member").mapInArrow(write, "file string, path string, records bigint")
    return materialize(written, "warc-files")


def read_warc(files: DataFrame, with_records: bool = True) -> DataFrame:
    """file, node (place in the file), offset and length (in the uncompressed file), digest, uri, key,
    warc_type and record (null unless with_records) of every record. files: file, path. A file is read by
    one task, which holds some records at a time."""
    fields = {"file": pa.string(), "node": pa.int64(), "offset": pa.int64(), "length": pa.int64(), "digest": pa.string(), "uri": pa.string(), "key": pa.string(), "warc_type": pa.string(), "record": pa.binary()}

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def told() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.record_batch({n: pa.array(list(c), kind) for (n, kind), c in zip(fields.items(), columns, strict=True)})

        for batch in batches:
            for name, path in zip(batch.column("file").to_pylist(), batch.column("path").to_pylist(), strict=True):
                system, own = split_uri(path)
                with system.open_input_stream(own, compression=None) as data:
                    chunks = iter(lambda data=data: data.read(CHUNK), b"")
                    for node, (offset, head, record) in enumerate(parse_warc(inflated(chunks))):
                        rows.append((name, node, offset, len(record), hashlib.sha256(record).hexdigest(), head.get("warc-target-uri"), head.get("warc-record-id"), head.get("warc-type"), record if with_records else None))
                        held += len(record) if with_records else 0
                        if held > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                            yield told()
                            rows, held = [], 0
        if rows:
            yield told()

    return files.select("file", "path").mapInArrow(records, "file string, node bigint, offset bigint, length bigint, digest string, uri string, key string, warc_type string, record binary")


def leaf_hash() -> Column:
    return F.sha2(F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "digest"), 256)


def hashed_files(files: DataFrame) -> DataFrame:
    """Level 0 of files of records: file, node, offset, length, digest, key, hash. Records are hashed where
    they are read, and don't travel."""
    return read_warc(files, with_records=False).select("file", "node", "offset", "length", "digest", "key", leaf_hash().alias("hash"))


def leaves(records: DataFrame, file_col: str = "file", offset_col: str = "offset", record_col: str = "record", key_col: str | None = None) -> DataFrame:
    """Level 0 of a table of records; those at the same offset of a file are ordered by digest. key is the
    record's identifier (null without key_col). A null record hashes as empty."""
    body = F.coalesce(named(record_col), F.lit(""))
    key = (named(key_col) if key_col else F.lit(None)).cast("string")
    rows = records.select(named(file_col).alias("file"), named(offset_col).cast("bigint").alias("offset"), F.octet_length(body).cast("bigint").alias("length"), F.sha2(body, 256).alias("digest"), key.alias("key"))
    node = F.row_number().over(Window.partitionBy("file").orderBy("offset", "digest")).cast("bigint") - 1
    return rows.select("file", node.alias("node"), "offset", "length", "digest", "key", leaf_hash().alias("hash"))


def parents(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level: each node hashes the range of offsets that its children cover, their number, and
    their hashes in order."""
    if "start" not in level.columns:
        level = level.withColumns({"start": F.col("offset"), "end": F.col("offset") + F.col("length")})
    children = level.groupBy("file", F.floor(F.col("node") / fanout).alias("node")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("c"))
    hashes = F.array_join(F.transform("c", lambda x: x["hash"]), "")
    return children.select("file", "node", "start", "end", F.sha2(F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"), F.size("c").cast("string"), hashes), 256).alias("hash"))


def tree(base: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves to the roots (node 0 of each file), each written to the shared folder."""
    levels = [materialize(base, "merkle")]
    most = levels[0].agg(F.max("node")).first()[0]
    while most:
        levels.append(materialize(parents(levels[-1], fanout), "merkle"))
        most //= fanout
    return levels


def audit(ours: list[DataFrame], theirs: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """file, node of the leaves that differ or that one side lacks, found by descending from the roots (of
    trees of unequal height: from the highest level that both have)."""
    below = None
    for k in range(min(len(ours), len(theirs)) - 1, -1, -1):
        sides = [x[k].select("file", "node", "hash") for x in (ours, theirs)]
        if below is not None:
            asked = F.col("file").eqNullSafe(F.col("f")) & (F.floor(F.col("node") / fanout) == F.col("n"))
            under = few(below.select(F.col("file").alias("f"), F.col("node").alias("n")))
            sides = [x.join(under, asked, "left_semi") for x in sides]
        met = sides[0].union(sides[1]).groupBy("file", "node").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("x"), F.max("hash").alias("y"))
        below = materialize(met.filter("n < 2 OR x <> y").select("file", "node"), "differing")
    return below


def longest_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, sorted by their first, whose seconds rise too."""
    tails, ends, before = [], [], []
    for n, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        before.append(ends[k - 1] if k else -1)
        tails[k : k + 1], ends[k : k + 1] = [j], [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def common_places(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal digests in both lists, rising in both: common beginnings and ends, then digests
    that each side has once, and so on between those; where all are repeated, equal ones by their turn. The time is
    n log n for each level of parts."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        in_a, in_b = Counter(a[i:k]), Counter(b[j:m])
        once = {b[y]: y for y in range(j, m) if in_b[b[y]] == 1}
        chain = longest_chain([(x, once[a[x]]) for x in range(i, k) if in_a[a[x]] == 1 and a[x] in once])
        if chain:
            for x, y in [*chain, (k, m)]:
                todo.append((i, x, j, y))
                i, j = x + 1, y + 1
            out += chain
        elif in_a.keys() & in_b.keys():
            out += longest_chain(by_turn(a[i:k], b[j:m], i, j))
    return sorted(out)


def by_turn(a: list[str], b: list[str], i: int, j: int) -> list[tuple[int, int]]:
    """Places (from i and j) of equal digests, the n-th of a kind in a with the n-th in b."""
    seen, turns = Counter(), {}
    for y, digest in enumerate(b):
        turns[digest, seen[digest]] = j + y
        seen[digest] += 1
    seen = Counter()
    met = []
    for x, digest in enumerate(a):
        if (y := turns.get((digest, seen[digest]))) is not None:
            met.append((i + x, y))
        seen[digest] += 1
    return met


def pairing(a: list[tuple[str, str | None]], b: list[tuple[str, str | None]], parts: tuple[list[int], list[int]] | None = None) -> list[tuple[int | None, int | None, str]]:
    """(place in a, place in b, status) of all records (digest, key) of a file's two replicas. parts: what
    lies between records left out since they agree; the numbers of both sides' parts."""
    same = common_places([x for x, _ in a], [x for x, _ in b])
    out = [(i, j, "ok") for i, j in same]
    left, right = sorted(set(range(len(a))) - {i for i, _ in same}), sorted(set(range(len(b))) - {j for _, j in same})
    gap_a, gap_b = [i for i, _ in same], [j for _, j in same]
    part_a, part_b = parts or ([0] * len(a), [0] * len(b))
    # The same bytes elsewhere; then, between the same neighbours, the same identifier; then, where a side has none, the same turn.
    rules = (("moved", lambda x, gap: x[0]), ("corrupt", lambda x, gap: (*gap, x[1])), ("corrupt", lambda x, gap: gap))
    for k, (status, name) in enumerate(rules):
        waiting = defaultdict(list)
        for j in reversed(right):
            waiting[name(b[j], (part_b[j], bisect_left(gap_b, j)))].append(j)
        met = []
        for i in left:
            others = waiting.get(name(a[i], (part_a[i], bisect_left(gap_a, i))))
            if others and (k < 2 or a[i][1] is None or b[others[-1]][1] is None):
                met.append((i, others.pop(), status))
        out += met
        left, right = sorted(set(left) - {i for i, _, _ in met}), sorted(set(right) - {j for _, j, _ in met})
    return [*out, *((i, None, "missing") for i in left), *((None, j, "extra") for j in right)]


FIXITY = "file string, node bigint, offset bigint, length bigint, digest string, other_offset bigint, other_digest string, status string"


def align(rows: pa.Table) -> pa.Table:
    """FIXITY of one file from side, file, node, offset, length, digest, key of both replicas' records that
    differ."""
    sides = [[], []]
    for r in rows.sort_by("node").to_pylist():
        sides[r["side"]].append(r)
    nodes = sorted({r["node"] for side in sides for r in side})
    starts = [x for k, x in enumerate(nodes) if not k or nodes[k - 1] != x - 1]
    parts = tuple([bisect_left(starts, r["node"] + 1) for r in side] for side in sides)
    found = []
    for i, j, status in pairing(*([(r["digest"], r["key"]) for r in side] for side in sides), parts):
        a, b = None if i is None else sides[0][i], None if j is None else sides[1][j]
        if status == "ok" and a["offset"] != b["offset"]:
            status = "shifted"
        found.append({c: (a or b)[c] for c in ("file", "node", "offset", "length")} | {"digest": a and a["digest"], "other_offset": b["offset"] if b else -1, "other_digest": b and b["digest"], "status": status})
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    return pa.Table.from_pylist(found, pa.schema([(n, kinds[k]) for n, k in map(str.split, FIXITY.split(", "))]))


def fixity(ours: DataFrame, theirs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row for every record of either replica: file, node, offset, length, digest, other_offset,
    other_digest, status: ok, shifted (the same bytes in the same order at another offset), moved (the same
    bytes, but not in the same order), corrupt (other bytes of the same identifier, or without identifiers
    of the same turn, between the same neighbours), missing or extra (one side has it).

    ours, theirs: level 0 as of leaves or hashed_files. Files are compared as they are named, those without a name
    as one file. Empty replicas give no rows, or only missing or extra ones. node, offset and length are the
    other side's for extra records only; other_offset is -1 for missing ones.
    """
    a, b = tree(ours, fanout), tree(theirs, fanout)
    found = audit(a, b, fanout).select(F.col("file").alias("f"), F.col("node").alias("n"))
    here = F.col("file").eqNullSafe(F.col("f")) & (F.col("node") == F.col("n"))
    differing = few(found)
    agreeing = a[0].join(differing, here, "left_anti").select("file", "node", "offset", "length", "digest", F.col("offset").alias("other_offset"), F.col("digest").alias("other_digest"), F.lit("ok").alias("status"))
    both = [x[0].join(differing, here, "left_semi").select(F.lit(k).alias("side"), "file", "node", "offset", "length", "digest", "key") for k, x in enumerate((a, b))]
    return agreeing.union(both[0].union(both[1]).groupBy("file").applyInArrow(align, FIXITY))


def page_replica(pages: DataFrame, damaged: bool) -> DataFrame:
    """file, page_id, tie, record of pages as WARC records, FILE_RECORDS identifiers to a file; rows with
    null identifiers have files of their own, of about as many rows. In the damaged replica, two of three files have another first byte
    in each page whose identifier ends in 37; of those, one in three has lost a record at place 120, has
    another one after place 180, and file 3 ends at place 900."""
    number = F.floor(F.coalesce("page_id", F.lit(-1)) / FILE_RECORDS)
    turn, place, key = F.pmod(number, F.lit(3)), F.pmod("page_id", F.lit(FILE_RECORDS)), F.col("page_id").cast("string")
    nameless = pages.filter("page_id IS NULL").count()
    shares = F.lit(max(1, -(-nameless // FILE_RECORDS)))
    name = F.when(F.col("page_id").isNull(), F.concat(F.lit("none-"), F.pmod(F.xxhash64("url", "html", F.monotonically_increasing_id()), shares).cast("string"))).otherwise(number.cast("string"))
    rows = pages.select("page_id", "url", "html", F.concat(F.lit("pages-"), name, F.lit(".warc")).alias("file"), key.alias("key"), turn.alias("turn"), place.alias("place"))
    if damaged:
        changed = (F.col("turn") < 2) & (F.pmod("page_id", F.lit(100)) == 37) & F.col("html").startswith("<")
        rows = rows.withColumn("html", F.when(changed, F.concat(F.lit("X"), F.substr("html", F.lit(2)))).otherwise(F.col("html")))
        more = rows.filter("turn = 0 AND place = 180").withColumn("key", F.concat("key", F.lit("-more")))
        rows = rows.filter("NOT coalesce(turn = 0 AND place = 120 OR file = 'pages-3.warc' AND place >= 900, false)").union(more)
    return rows.withColumn("record", warc_record(F.col("url"), F.col("html"), F.col("key"))).select("file", "page_id", F.sha2("record", 256).alias("tie"), "record")


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fixity of pages, written as WARC files and read back, against a replica damaged as page_replica says.
    Null columns count as empty, repeated rows are records of their own, an empty table gives no rows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    ours, theirs = (hashed_files(write_warc(page_replica(pages, damaged), "file", ["page_id", "tie"], "record")) for damaged in (False, True))
    return fixity(ours, theirs)


QUERIES = {"op7_warc_fixity": op7_warc_fixity}


def oracle() -> str:
    """Records compared one by one, by identifier; what stands at another offset is shifted."""
    def header(name: str, value: str) -> str:
        return f"chr(13) || chr(10) || '{name}: ' || {value}"

    bare = "translate(coalesce(url, ''), chr(13) || chr(10), '')"
    record = f"'WARC/1.0' || {header('WARC-Type', chr(39) + 'resource' + chr(39))} || {header('WARC-Record-ID', chr(39) + '<urn:record:' + chr(39) + ' || key || ' + chr(39) + '>' + chr(39))} || {header('WARC-Target-URI', bare)} || {header('Content-Length', 'strlen(body)')} || repeat(chr(13) || chr(10), 2) || body || repeat(chr(13) || chr(10), 2)"

    def side(source: str) -> str:
        return f"""SELECT file, key, row_number() OVER w - 1 AS node, (sum(n) OVER w - n)::BIGINT AS "offset", n AS length, digest
  FROM (SELECT page_id, file, key, strlen(r)::BIGINT AS n, sha256(r) AS digest FROM (SELECT page_id, file, key, {record} AS r FROM {source}))
  WINDOW w AS (PARTITION BY file ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

    return f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, page_id::VARCHAR AS key, (page_id // {FILE_RECORDS}) % 3 AS turn, page_id % {FILE_RECORDS} AS place, 'pages-' || page_id // {FILE_RECORDS} || '.warc' AS file FROM pages),
c AS (SELECT * REPLACE (CASE WHEN turn < 2 AND page_id % 100 = 37 AND starts_with(body, '<') THEN 'X' || substr(body, 2) ELSE body END AS body) FROM p),
d AS (SELECT * FROM c WHERE NOT (turn = 0 AND place = 120 OR file = 'pages-3.warc' AND place >= 900) UNION ALL SELECT * REPLACE (key || '-more' AS key) FROM c WHERE turn = 0 AND place = 180),
a AS ({side('p')}), b AS ({side('d')})
SELECT coalesce(a.file, b.file) AS file, coalesce(a.node, b.node) AS node, coalesce(a."offset", b."offset") AS "offset", coalesce(a.length, b.length) AS length,
       a.digest AS digest, coalesce(b."offset", -1) AS other_offset, b.digest AS other_digest,
       CASE WHEN a.digest IS NULL THEN 'extra' WHEN b.digest IS NULL THEN 'missing' WHEN a.digest <> b.digest THEN 'corrupt' WHEN a."offset" <> b."offset" THEN 'shifted' ELSE 'ok' END AS status
FROM a FULL JOIN b ON a.file = b.file AND a.key = b.key
"""


ORACLES = {"op7_warc_fixity": oracle()}
