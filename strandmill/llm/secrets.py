"""Secret scans with a trigram inverted index.

Each rule's regex yields a Boolean query of trigrams that every match must hold. A block of documents (the
rows of an Arrow batch, a few MB) gets an inverted index of the trigrams that some rule asks for; postings
are intersected and united by the queries, and only the documents left are searched with the regex. Rules
without mandatory trigrams search all documents. The index is partitioned by document, so no postings
cross the network.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from re import _constants as sre  # Python 3.11 or later
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.llm.common import named, pieces, table

#: Alternatives of an OR that are told apart; beyond, the part of the regex asks for nothing.
MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """group: what must have least characters; matches in which it is shorter are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern)

    def spans(self, text: str) -> Iterator[tuple[str, int, int]]:
        for m in self.compiled.finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield self.kind, m.start(), m.end()


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


BASE = (
    Rule("assign", "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    # A run of letters is passed over whole, found or not, so that time stays linear in the text.
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+(\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)?", 1),
    Rule("url_password", r"(?<![a-z])[a-z]+://[A-Za-z0-9._-]+:[^\s:@/]{3,}@"),
)
RULES = (*BASE, *MORE)


def lower(text: str) -> str:
    """A-Z only, as bytes.lower() does with the texts."""
    return "".join(c.lower() if c.isascii() else c for c in text)


def spellings(code: int, loose: bool) -> str | None:
    """A literal in lower case. loose: letters match in any case, as Unicode has it: i, k and s have partners
    beyond A-Z, and other signs may have, so nothing is asked of them."""
    c = chr(code)
    return lower(c) if not loose or c.isascii() and c not in "iksIKS" else None


def alternatives(node, loose: bool = False) -> list[str] | None:
    """The strings, in lower case, that a part of a parsed regex can be, if they are few; else None."""
    op, arg = node
    if op is sre.LITERAL:
        c = spellings(arg, loose)
        return None if c is None else [c]
    if op is sre.IN:
        chars: set[str | None] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(spellings(x, loose))
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                chars |= {spellings(c, loose) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return sorted(chars) if None not in chars and len(chars) <= 8 else None
    if op is sre.SUBPATTERN:
        return sequence(arg[3], looseness(arg[1], arg[2], loose))
    if op is sre.BRANCH:
        own = [sequence(x, loose) for x in arg[1]]
        return None if None in own else sorted({s for x in own for s in x})
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 8:
        own = sequence(arg[2], loose)
        if own is None:
            return None
        out, some = [""] if arg[0] == 0 else [], [""]
        for k in range(1, arg[1] + 1):
            some = [a + b for a in some for b in own]
            if len(some) > MAX_ALTERNATIVES:
                return None
            out += some if k >= arg[0] else []
        return sorted(set(out))
    return [""] if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT) else None


def looseness(added: int, removed: int, loose: bool) -> bool:
    """Whether letters match in any case beyond A-Z under these changes of flags."""
    if added & re.ASCII:
        return False
    return bool(added & re.IGNORECASE) or loose and not removed & re.IGNORECASE


def sequence(nodes, loose: bool = False) -> list[str] | None:
    out = [""]
    for node in nodes:
        own = alternatives(node, loose)
        if own is None or len(own) * len(out) > MAX_ALTERNATIVES:
            return None
        out = [a + b for a in out for b in own]
    return out


def trigram_query(pattern: str) -> list[list[frozenset[bytes]]]:
    """A conjunction of disjunctions of conjunctions: every match has, for each clause, all trigrams of
    one of its sets (UTF-8, lower case). No clauses: the rule must search everything."""
    clauses: list[list[frozenset[bytes]]] = []
    exact = [""]

    def close() -> None:
        sets = {frozenset(b[i : i + 3] for i in range(len(b) - 2)) for b in (s.encode() for s in exact)}
        if frozenset() not in sets:
            clauses.append(sorted(sets, key=sorted))
        exact[:] = [""]

    def walk(nodes, loose: bool) -> None:
        for node in nodes:
            own = alternatives(node, loose)
            if own is not None and len(own) * len(exact) <= MAX_ALTERNATIVES:
                exact[:] = [a + b for a in exact for b in own]
                continue
            close()
            op, arg = node
            if own is not None:
                exact[:] = own
            elif op is sre.SUBPATTERN:
                walk(arg[3], looseness(arg[1], arg[2], loose))
                close()
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                walk(arg[2], loose)
                close()

    parsed = parser.parse(pattern)
    walk(parsed, looseness(parsed.state.flags, 0, False))
    close()
    return clauses


class BlockIndex:
    """Inverted index of a block: for each wanted trigram the rows whose text, in lower case, has it."""

    def __init__(self, wanted: frozenset[bytes]):
        self.codes = np.array(sorted(int.from_bytes(t, "big") for t in wanted), np.uint32)
        self.asked = np.zeros(1 << 24, bool)
        self.asked[self.codes] = True

    def build(self, texts: list[bytes]) -> None:
        self.rows = len(texts)
        data = np.frombuffer(b"".join(t.lower() for t in texts), np.uint8).astype(np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        self.postings: dict[int, np.ndarray] = {}
        if len(data) < 3:
            return
        codes = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        at = np.flatnonzero(self.asked[codes])
        row = np.searchsorted(ends, at, side="right")
        inside = row == np.searchsorted(ends, at + 2, side="right")
        code, row = codes[at[inside]], row[inside]
        for c in np.unique(code).tolist():
            self.postings[c] = np.unique(row[code == c])

    def find(self, query: list[list[frozenset[bytes]]]) -> np.ndarray:
        out = np.arange(self.rows)
        none = np.empty(0, np.int64)
        for clause in query:
            union = []
            for trigrams in clause:
                own = out
                for t in trigrams:
                    own = np.intersect1d(own, self.postings.get(int.from_bytes(t, "big"), none), assume_unique=True)
                union.append(own)
            out = np.unique(np.concatenate(union))
        return out


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """array<struct<kind, start, end>> of all matches, by rule and then by place, in code points, end
    exclusive; empty for null and empty texts. Matches of one rule don't overlap, those of two may."""

    @F.arrow_udf("array<struct<kind: string, start: bigint, end: bigint>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        queries = [trigram_query(r.pattern) for r in rules]
        index = BlockIndex(frozenset(t for q in queries for clause in q for s in clause for t in s))
        for batch in batches:
            out: list[list[dict]] = []
            for part in pieces(batch):
                texts = [t or "" for t in part.to_pylist()]
                index.build([t.encode() for t in texts])
                found: list[list[dict]] = [[] for _ in texts]
                for rule, query in zip(rules, queries, strict=True):
                    for k in index.find(query).tolist():
                        found[k] += [{"kind": kind, "start": a, "end": b} for kind, a, b in rule.spans(texts[k])]
                out += found
            yield pa.array(out, SPANS)

    return spans(text)


def find_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with all rows and columns and `secrets`, the spans of its secrets (replaced if there is one)."""
    return docs.withColumn("secrets", scan(named(text_col), rules))


def joined(spans: Column, order: dict[str, int]) -> Column:
    """kind:start:end by start, then by the kinds' order, comma-joined."""
    rank = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document. Null and empty texts have none, repeated rows are searched each, an
    empty table gives no rows."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    order = {r.kind: k for k, r in enumerate(RULES)}
    def of(*kinds: str) -> Column:
        return F.filter("secrets", lambda s: s["kind"].isin(*kinds))

    base = of(*[r.kind for r in BASE])
    counts = [F.size(of(r.kind)).cast("bigint").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base, order), 256).alias("base_sha256"), joined(F.col("secrets"), order).alias("spans"))


QUERIES = {"op10_secrets": op10_secrets}
ORACLES: dict[str, str] = {}
