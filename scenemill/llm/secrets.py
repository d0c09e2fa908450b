"""Secret scans by one deterministic automaton for all rules.

The automaton reads a text's bytes once and tells where a match of a rule's ``find`` pattern ends. The
rule's own automata, run from there, give the span: backwards to where the match begins, forwards to
where the longest one ends. Matches of a rule are leftmost and do not overlap; a match that fails the
rule's length test is dropped, and the text it covers stays used up.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenemill.llm.automaton import Dfa, compile_rules
from scenemill.llm.common import bounded_batches, text_of


@dataclass(frozen=True)
class Rule:
    """``find``: the shortest text that shows a match; ``whole``: all of it. ``least`` bytes are asked of the match or,
    if ``tail``, of its part from the last byte of the shortest one on.

    No shortest match may hold that of a match which begins later.
    """

    kind: str
    find: str
    whole: str
    least: int
    tail: bool = False
    ignore_case: bool = False


_KEY = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

#: The base kinds first; the others are widely published token formats.
RULES = (
    Rule("assign", _KEY + "[A-Za-z0-9+/_.=-]", _KEY + "[A-Za-z0-9+/_.=-]+", 8, tail=True, ignore_case=True),
    Rule("access", "AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{32}", "[0-9a-f]{32,}", 32),
    Rule("github", "gh[oprsu]_[A-Za-z0-9]", "gh[oprsu]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9]", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", "AIza[A-Za-z0-9_-]", "AIza[A-Za-z0-9_-]+", 39),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]", "[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]*)?", 30),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 27),
)

BASE_KINDS = ("assign", "access", "hex")


@dataclass
class Scanner:
    rules: tuple[Rule, ...]
    combined: Dfa
    back: list[Dfa]
    forward: list[Dfa]

    @classmethod
    def of(cls, rules: tuple[Rule, ...]) -> Scanner:
        combined = compile_rules([(r.find, r.ignore_case) for r in rules], anywhere=True)
        back = [compile_rules([(r.find, r.ignore_case)], anywhere=False, backwards=True) for r in rules]
        forward = [compile_rules([(r.whole, r.ignore_case)], anywhere=False) for r in rules]
        return cls(rules, combined, back, forward)

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in bytes, by start, then rule."""
        table, accepting, rules = self.combined.table, self.combined.accepting, self.combined.rules
        state, used, found = self.combined.start, [0] * len(self.rules), []
        for i, c in enumerate(data.translate(self.combined.classes)):
            state = table[state + c]
            if state >= accepting:
                for k in rules[state]:
                    if i < used[k]:
                        continue
                    before = self.back[k].longest(data, i, used[k] - 1, -1)
                    if before is None:
                        continue
                    start = before + 1
                    end = self.forward[k].longest(data, start, len(data))
                    used[k] = end
                    rule = self.rules[k]
                    if end - (i if rule.tail else start) >= rule.least:
                        found.append((start, k, end))
        return sorted(found)

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, end exclusive."""
        data = text.encode("utf-8", "surrogatepass")
        found = self.scan(data)
        if len(data) != len(text):
            # One walk over the text: each place is counted on from the place before.
            at, before, chars = {}, 0, 0
            for b in sorted({x for a, _, b in found for x in (a, b)}):
                chars += len(data[before:b].decode("utf-8", "surrogatepass"))
                at[b], before = chars, b
            return [(self.rules[k].kind, at[a], at[b]) for a, k, b in found]
        return [(self.rules[k].kind, a, b) for a, k, b in found]


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner.of(rules)


_SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def spans_column(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The secrets of a text as ``array<struct<kind, start, end>>``."""

    def spans(texts: pa.Array) -> pa.Array:
        scan = scanner(rules)
        out = []
        for t in texts:
            found = scan.spans(t.as_py()) if t.is_valid else []
            out.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
        return pa.array(out, _ARROW)

    spans.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(spans, T.ArrayType(_SPAN))(text)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: ``id_col, secrets`` (``array<struct<kind, start, end>>`` by start, then rule).

    Positions are code points of the text, ends exclusive. Null texts count as empty and hold none; repeated
    rows give repeated results; extra columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col), spans_column(text_of(text_col), rules).alias("secrets"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``find_secrets`` as counts of the base kinds, a digest of their spans, and all spans as text."""
    found = find_secrets(docs, id_col, text_col)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s.kind.isin(*BASE_KINDS))
    return found.select(id_col, *[count(k) for k in BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
