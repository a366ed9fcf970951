"""SQL building blocks of the oracles: each is one common table expression over the driver's tables."""

from __future__ import annotations

DNA = "translate(hex(coalesce(text, '')), '0123456789ABCDEF', 'ACGTACGTACGTACGT')"


def rc(dna: str) -> str:
    return f"reverse(translate({dna}, 'ACGTUacgtu', 'TGCAAtgcaa'))"


def offsets(order: str) -> str:
    return f"coalesce(sum(len + 1) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT"


def words(name: str, source: str, more: str = "") -> str:
    """All 32-letter words; texts are cut into pieces of 256 first, as a substring costs its distance from the start."""
    return f"""{name} AS MATERIALIZED (SELECT {more}seq, g_off + c + i AS pos, substring(piece, i + 1, 32) AS word FROM (
  SELECT {more}seq, g_off, c, piece, unnest(range(0, length(piece) - 31)) AS i FROM (
  SELECT {more}seq, g_off, c, substring(dna, c + 1, 287) AS piece FROM (SELECT {more}seq, g_off, dna, unnest(range(0, greatest(len - 31, 0), 256)) AS c FROM {source}))))"""


BLOCKS = {
    "x": f"""x AS MATERIALIZED (SELECT *, {offsets('seq')} AS g_off FROM (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS seq, doc_id::VARCHAR AS ident, dna, length(dna) AS len FROM (SELECT doc_id, {DNA} AS dna FROM documents)))""",
    "y": f"""y AS MATERIALIZED (SELECT *, {offsets('seq')} AS g_off FROM (
  SELECT row_number() OVER (ORDER BY item_id) - 1 AS seq, item_id::VARCHAR AS ident, dna, length(dna) AS len FROM (
    SELECT item_id, CASE WHEN item_id % 2 = 1 THEN {rc('d')} ELSE d END AS dna FROM (SELECT item_id, {DNA} AS d FROM benchmark))))""",
    "ys": f"""ys AS MATERIALIZED (SELECT 'f' AS strand, seq, dna, len, g_off FROM y UNION ALL SELECT 'r', seq, dna, len, {offsets('seq')} FROM (
  SELECT (SELECT count(*) FROM y) - 1 - seq AS seq, {rc('dna')} AS dna, len FROM y))""",
    "kx": words("kx", "x"),
    "ky": words("ky", "y"),
    "kys": words("kys", "ys", "strand, "),
}


def hits_blocks(k: int = 32, fl: int = 1000, strands: str = "fr") -> list[str]:
    which = ", ".join(f"'{s}'" for s in strands)
    return [
        BLOCKS["x"],
        BLOCKS["y"],
        BLOCKS["ys"],
        BLOCKS["kx"],
        BLOCKS["kys"],
        f"fx AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY word) AS num, substring(word, 1, {k}) AS key FROM kx WHERE substring(word, 1, {k}) IN (SELECT substring(word, 1, {k}) FROM kys)) WHERE num <= {fl})",
        f"fy AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY strand, word) AS num, substring(word, 1, {k}) AS key FROM kys WHERE strand IN ({which})) WHERE num <= {fl})",
        'hits AS MATERIALIZED (SELECT strand, fx.pos - fy.pos AS diag, fx.pos AS "posX", fy.pos AS "posY", fx.seq AS "seqX", fy.seq AS "seqY" FROM fx JOIN fy USING (key))',
    ]


def thinned(k: int = 32, by: str = "") -> str:
    gap = 2 * k - 1
    return f"""thinned AS MATERIALIZED (SELECT {by}strand, diag, "posX", "posX" - diag AS "posY", "seqX", "seqY" FROM (
  SELECT {by}strand, diag, "seqX", "seqY", unnest(list_reduce(list_transform(list("posX" ORDER BY "posX"), lambda p: [p]), lambda a, p: CASE WHEN p[1] > a[-1] + {gap} THEN a || p ELSE a END)) AS "posX"
  FROM hits GROUP BY {by}strand, diag, "seqX", "seqY"))"""


def thin_blocks(**args) -> list[str]:
    return [*hits_blocks(**args), thinned(args.get("k", 32))]


def used_blocks(lmin: int = 100, simthr: float = 65, **args) -> list[str]:
    return [*thin_blocks(**args), *extended_blocks(lmin, simthr, args.get("k", 32))]


def extended_blocks(lmin: int = 100, simthr: float = 65, k: int = 32, by: str = "", on_x: str = "", on_y: str = "", n_y: str = "(SELECT count(*) FROM y)") -> list[str]:
    delta = "CASE WHEN a = 'N' OR b = 'N' THEN -1 WHEN a = b THEN 4 ELSE -4 END"
    return [
        f"""seed AS MATERIALIZED (SELECT row_number() OVER () AS h, t.*, "posX" - x.g_off AS p, "posY" - ys.g_off AS q, 
  least(x.len - p, ys.len - q) AS fn, least(p, q) AS bn, substring(x.dna, p + 1, fn) AS fx, substring(ys.dna, q + 1, fn) AS fy,
  reverse(substring(x.dna, p - bn + 1, bn)) AS bx, reverse(substring(ys.dna, q - bn + 1, bn)) AS bz
  FROM thinned t JOIN x ON {on_x}x.seq = t."seqX" JOIN ys ON {on_y}ys.strand = t.strand AND ys.seq = t."seqY")""",
        f"""fw AS (SELECT h, t, {4 * k} + sum(d) OVER w AS c, sum((d = 4)::INT) OVER w AS m FROM (SELECT h, t, {delta} AS d FROM (
  SELECT h, t, substring(fx, t + 1, 1) AS a, substring(fy, t + 1, 1) AS b FROM (SELECT h, fx, fy, unnest(range({k}, fn)) AS t FROM seed)))
  WINDOW w AS (PARTITION BY h ORDER BY t ROWS UNBOUNDED PRECEDING))""",
        "fstop AS (SELECT h, min(t) AS stop FROM fw WHERE c < 0 GROUP BY h)",
        f"fbest AS (SELECT h, max(c) AS c, arg_max(t, (c, -t)) AS t, arg_max(m, (c, -t)) AS m FROM fw LEFT JOIN fstop USING (h) WHERE t < coalesce(stop, t + 1) AND c > {4 * k} GROUP BY h)",
        f"""half AS MATERIALIZED (SELECT seed.*, coalesce(c, {4 * k}) AS fs, coalesce(t, {k}) AS ahead, {k} + coalesce(m, 0) AS fi FROM seed LEFT JOIN fbest USING (h))""",
        f"""bw AS (SELECT h, t, fs, fs + sum(d) OVER w AS c, sum((d = 4)::INT) OVER w AS m FROM (SELECT h, fs, t, {delta} AS d FROM (
  SELECT h, fs, t, substring(bx, t, 1) AS a, substring(bz, t, 1) AS b FROM (SELECT h, fs, bx, bz, unnest(range(1, bn + 1)) AS t FROM half)))
  WINDOW w AS (PARTITION BY h ORDER BY t ROWS UNBOUNDED PRECEDING))""",
        "bstop AS (SELECT h, min(t) AS stop FROM bw WHERE c < 0 GROUP BY h)",
        "bbest AS (SELECT h, max(c) AS c, arg_max(t, (c, -t)) AS t, arg_max(m, (c, -t)) AS m FROM bw LEFT JOIN bstop USING (h) WHERE t < coalesce(stop, t + 1) AND c > fs GROUP BY h)",
        f"""extended AS MATERIALIZED (SELECT *, length > {lmin} AND similarity > {float(simthr)}::FLOAT AS accepted, row_number() OVER (PARTITION BY {by}strand, diag ORDER BY "posX") AS rn FROM (
  SELECT *, (score * 100.0::DOUBLE / (length * 4))::FLOAT AS similarity FROM (
  SELECT {by}strand, diag, "posX", "posY", "seqX", "seqY", "posX" - coalesce(t, 0) - "seqX" AS "xStart", "posY" - coalesce(t, 0) - "seqY" AS "yStart",
         "posX" + ahead - "seqX" AS "xEnd", "posY" + ahead - "seqY" AS "yEnd", (ahead + coalesce(t, 0) + 1)::BIGINT AS length, (fi + coalesce(m, 0))::BIGINT AS ident, coalesce(c, fs)::BIGINT AS score
  FROM half LEFT JOIN bbest USING (h))))""",
        f"""fold AS (SELECT {by}strand, diag, rn, true AS is_used, CASE WHEN accepted THEN "posX" + length ELSE "posX" - 1 END AS fin FROM extended WHERE rn = 1
  UNION ALL SELECT {"".join(f"e.{c.strip()}, " for c in by.split(",") if c.strip())}e.strand, e.diag, e.rn, f.fin <= e."posX", CASE WHEN f.fin <= e."posX" AND e.accepted THEN e."posX" + e.length ELSE f.fin END
  FROM fold f JOIN extended e ON {"".join(f"e.{c.strip()} = f.{c.strip()} AND " for c in by.split(",") if c.strip())}e.strand = f.strand AND e.diag = f.diag AND e.rn = f.rn + 1)""",
        f"used AS MATERIALIZED (SELECT e.* FROM extended e JOIN fold USING ({by}strand, diag, rn) WHERE is_used)",
        f"""fragments AS MATERIALIZED (SELECT {by}diag, "xStart", "yStart", "xEnd", "yEnd", length, ident, score, round(similarity::DOUBLE, 4) AS similarity, "seqX",
  CASE strand WHEN 'r' THEN {n_y} - 1 - "seqY" ELSE "seqY" END AS "seqY", 0::BIGINT AS block, strand FROM used WHERE accepted)""",
    ]


#: genome, place, ident and dna of the records of two collections: documents by source, and turns of
#: conversations by conversation, those with odd numbers reverse-complemented.
SOURCES = f"SELECT source AS genome, doc_id AS place, doc_id::VARCHAR AS ident, {DNA} AS dna FROM documents"
TALKS = f"SELECT (conv_id % 5)::VARCHAR AS genome, conv_id * 1000 + turn AS place, conv_id || '-' || turn AS ident, CASE WHEN turn % 2 = 1 THEN {rc(DNA)} ELSE {DNA} END AS dna FROM conversations"


def collection_blocks(records: str, fl: int, k: int = 32, lmin: int = 100, simthr: float = 65, pending: str = "true") -> list[str]:
    """All pairs of genomes, both strands; pending: which pairs."""
    def placed(order: str) -> str:
        return f"coalesce(sum(len + 1) OVER (PARTITION BY genome ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT"

    return [
        f"""x AS MATERIALIZED (SELECT *, {placed('seq')} AS g_off FROM (
  SELECT genome, row_number() OVER (PARTITION BY genome ORDER BY place) - 1 AS seq, ident, dna, length(dna) AS len FROM ({records})))""",
        f"""ys AS MATERIALIZED (SELECT 'f' AS strand, genome, seq, dna, len, g_off FROM x UNION ALL SELECT 'r', genome, seq, dna, len, {placed('seq')} FROM (
  SELECT genome, count(*) OVER (PARTITION BY genome) - 1 - seq AS seq, {rc('dna')} AS dna, len FROM x))""",
        words("kys", "ys", "strand, genome, "),
        f"""met AS (SELECT key FROM (SELECT substring(word, 1, {k}) AS key, genome FROM kys) GROUP BY key HAVING count(DISTINCT genome) > 1)""",
        f"""often AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY genome, strand, word) AS num, substring(word, 1, {k}) AS key FROM kys WHERE substring(word, 1, {k}) IN (FROM met)) WHERE num <= {fl})""",
        f"""hits AS MATERIALIZED (SELECT a.genome AS genome_x, b.genome AS genome_y, b.strand, a.pos - b.pos AS diag, a.pos AS "posX", b.pos AS "posY", a.seq AS "seqX", b.seq AS "seqY"
  FROM often a JOIN often b ON a.key = b.key AND a.strand = 'f' AND a.genome < b.genome WHERE {pending})""",
        thinned(k, "genome_x, genome_y, "),
        *extended_blocks(lmin, simthr, k, "genome_x, genome_y, ", "x.genome = t.genome_x AND ", "ys.genome = t.genome_y AND ", "(SELECT count(*) FROM x WHERE x.genome = genome_y)"),
    ]


def query(blocks: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(blocks) + "\n" + select


def of(names: str, select: str) -> str:
    return query([BLOCKS[n] for n in names.split()], select)
