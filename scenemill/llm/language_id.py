"""Language identification by prediction by partial matching with frozen statistics.

For each language a tree of byte contexts up to ``ORDER`` bytes long counts which bytes follow. A byte
costs -log2 n(byte)/(N + d) in the longest context that has seen it, and each longer context that has
not charges its escape, -log2 d/(N + d) (N: bytes seen after the context, d: how many distinct ones).
Below the empty context every byte costs 8 bits. A text's code length under a language is the sum.

The statistics are frozen after training, so every cost is a fixed function of the last ORDER + 1 bytes.
The trees of all languages are merged into one table per order, a row per gram with one column of costs
per language; scoring a batch is one hashed look-up per byte, and shorter grams only for the misses.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenemill.llm.common import bounded_batches, fresh

ORDER = 3

#: The bound on what a model is fitted on: this many labelled rows of each language, and this many bytes of them.
SAMPLE_ROWS = 400
SAMPLE_BYTES = 1 << 20

UNDETERMINED = "und"

#: Code lengths tell languages by letters: A-Z become a-z, other ASCII bytes become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Bytes scored at a time.
_BLOCK = 1 << 20


class _Table:
    """Rows found by a 32-bit key: three hashed probes, then a binary search for the few that remain."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.keys, self.rows = keys, rows
        bits = max(10, int(4 * len(keys)).bit_length())
        self.probes, rest = [], np.arange(len(keys))
        for odd in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35):
            slots = np.full(1 << bits, -1, np.int32)
            at = self._slot(keys[rest], odd, bits)
            slots[at[::-1]] = rest[::-1]
            self.probes.append((odd, bits, slots))
            rest = rest[slots[at] != rest]
        self.rest_keys, self.rest_at = keys[rest], rest

    @staticmethod
    def _slot(keys: np.ndarray, odd: int, bits: int) -> np.ndarray:
        return (keys * np.uint32(odd)) >> np.uint32(32 - bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        odd, bits, slots = self.probes[0]
        at = slots[self._slot(keys, odd, bits)]
        at = np.where(self.keys[at] == keys, at, np.int32(-1))
        for odd, bits, slots in self.probes[1:]:
            miss = np.flatnonzero(at < 0)
            if not len(miss):
                return at
            k = keys[miss]
            got = slots[self._slot(k, odd, bits)]
            at[miss] = np.where(self.keys[got] == k, got, np.int32(-1))
        if len(self.rest_keys) and len(miss := np.flatnonzero(at < 0)):
            k = keys[miss]
            got = np.minimum(np.searchsorted(self.rest_keys, k), len(self.rest_keys) - 1)
            at[miss] = np.where(self.rest_keys[got] == k, self.rest_at[got], -1)
        return at


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """The key of the order + 1 bytes that end at each byte from position ORDER on."""
    key = data[ORDER:].astype(np.uint32)
    for back in range(1, order + 1):
        key |= data[ORDER - back : len(data) - back].astype(np.uint32) << np.uint32(8 * back)
    return key


def _fold(text: bytes) -> bytes:
    return b" " * ORDER + text.translate(_FOLD)


@dataclass
class LanguageModel:
    """Merged context trees; ``fit`` once, then ``score`` texts."""

    languages: list[str]
    costs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    escapes: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def fit(cls, samples: dict[str, list[bytes]]) -> LanguageModel:
        """``samples``: language to texts in UTF-8. Equal samples give equal models."""
        languages = sorted(samples)
        model = cls(languages)
        if not languages:
            return model
        streams = [np.concatenate([np.frombuffer(_fold(t), np.uint8) for t in samples[g]] or [np.empty(0, np.uint8)]) for g in languages]
        counted = [[np.unique(_grams(s, k), return_counts=True) if len(s) > ORDER else (np.empty(0, np.uint32), np.empty(0, np.int64)) for s in streams] for k in range(ORDER + 1)]
        below = np.full((1, len(languages)), 8.0, np.float64)  # the order below the empty context
        below_keys = None
        for k in range(ORDER + 1):
            keys = np.unique(np.concatenate([c[0] for c in counted[k]]))
            contexts = np.unique(keys >> np.uint32(8))
            cost, escape = np.empty((len(keys), len(languages))), np.zeros((len(contexts), len(languages)))
            shorter = keys & np.uint32((1 << 8 * k) - 1)
            base = below[np.searchsorted(below_keys, shorter)] if below_keys is not None else np.broadcast_to(below, cost.shape)
            of_key = np.searchsorted(contexts, keys >> np.uint32(8))
            for g, (own, n) in enumerate(counted[k]):
                at = np.searchsorted(keys, own)
                ctx = of_key[at]
                seen = np.bincount(ctx, weights=n, minlength=len(contexts))
                distinct = np.bincount(ctx, minlength=len(contexts))
                known = distinct > 0
                escape[known, g] = -np.log2(distinct[known] / (seen[known] + distinct[known]))
                cost[:, g] = escape[of_key, g] + base[:, g]
                cost[at, g] = -np.log2(n / (seen[ctx] + distinct[ctx]))
            model.costs.append((keys, cost.astype(np.float32)))
            model.escapes.append((contexts, escape.astype(np.float32)))
            below, below_keys = cost, keys
        return model

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "costs": self.costs, "escapes": self.escapes}

    def _tables(self) -> list[tuple[_Table, _Table]]:
        found = self.__dict__.get("_built")
        if found is None:
            found = self.__dict__["_built"] = [(_Table(*c), _Table(*e)) for c, e in zip(self.costs, self.escapes)]
        return found

    def byte_costs(self, data: np.ndarray) -> np.ndarray:
        """Bits of each byte after the first ORDER, a column per language."""
        tables = self._tables()
        top, _ = tables[ORDER]
        keys = _grams(data, ORDER)
        at = top.find(keys)
        out = top.rows[at] if len(top.rows) else np.zeros((len(keys), len(self.languages)), np.float32)
        open_ = np.flatnonzero(at < 0)
        if len(open_):
            total = np.zeros((len(open_), len(self.languages)), np.float32)
            left = np.arange(len(open_))
            for k in range(ORDER, -1, -1):
                grams = keys[open_[left]] & np.uint32((1 << 8 * (k + 1)) - 1)
                at = tables[k][0].find(grams)
                hit = at >= 0
                total[left[hit]] += tables[k][0].rows[at[hit]]
                left, grams = left[~hit], grams[~hit]
                if not len(left):
                    break
                ctx = tables[k][1].find(grams >> np.uint32(8))
                seen = ctx >= 0
                total[left[seen]] += tables[k][1].rows[ctx[seen]]
            else:
                total[left] += 8.0
            out[open_] = total
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.languages)))
        held: list[bytes] = []
        of: list[int] = []
        size = 0

        def flush() -> None:
            data = np.frombuffer(b"".join(held), np.uint8)
            costs = self.byte_costs(data)
            ends = np.cumsum([len(h) for h in held])
            starts = ends - [len(h) for h in held]
            # The bytes of a text are those from its start + ORDER on; row i of the costs is byte i + ORDER.
            for i, a, b in zip(of, starts.tolist(), (ends - ORDER).tolist()):
                out[i] += costs[a:b].sum(axis=0, dtype=np.float64)

        for i, text in enumerate(texts):
            folded = _fold(text)
            for lo in range(0, max(1, len(folded) - ORDER), _BLOCK):
                piece = folded[lo : lo + _BLOCK + ORDER]
                held.append(piece)
                of.append(i)
                size += len(piece)
                if size >= _BLOCK:
                    flush()
                    held, of, size = [], [], 0
        if held:
            flush()
        return out

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        """The language of least code length and its posterior under equal priors; ties go to the first in order."""
        labels, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        which = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t.decode("utf-8", "replace")))]
        if which and self.languages:
            bits = self.code_lengths([texts[i] for i in which])
            best = bits.argmin(axis=1)
            odds = np.exp2(np.maximum(bits.min(axis=1)[:, None] - bits, -1000.0)).sum(axis=1)
            for i, b, s in zip(which, best.tolist(), (1.0 / odds).tolist()):
                labels[i], scores[i] = self.languages[b], s
        return labels, scores


def held_out_column(id_col: str) -> Column:
    """True for the third of ids that no model may learn from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_sample(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES
) -> dict[str, list[bytes]]:
    """Labelled texts that are not held out: about ``rows`` of each language, never over twice that, and ``most_bytes`` in all.

    Which rows are drawn depends on ids and texts alone. Counts come first, so that each language's share of
    its hashed rows is known; the drawn rows of a language are put in order of their hash and cut by count and
    running bytes before any is collected, so the driver gets at most ``most_bytes`` and one text more of each.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out_column(id_col))
    known = known.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    draw = F.xxhash64("id", "text", F.lit("sample"))
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows / n))).otherwise(share)
    drawn = known.where(F.pmod(draw, F.lit(1 << 30)) / float(1 << 30) < share)
    drawn = drawn.withColumn("draw", draw).withColumn("raw", F.substring(F.col("text").cast("binary"), 1, most_bytes))
    drawn = drawn.groupBy("lang", "id", "draw").agg(F.min("raw").alias("raw"), F.count("*").alias("n"))  # repeated rows are one row drawn n times
    order = Window.partitionBy("lang").orderBy("draw", "id").rowsBetween(Window.unboundedPreceding, -1)
    nth, held = F.coalesce(F.sum("n").over(order), F.lit(0)), F.coalesce(F.sum(F.octet_length("raw") * F.col("n")).over(order), F.lit(0))
    drawn = drawn.select("lang", "id", "raw", "n", nth.alias("nth"), held.alias("held"))
    drawn = drawn.where((F.col("nth") < 2 * rows) & (F.col("held") < most_bytes)).select("lang", "id", "raw", F.least("n", 2 * rows - F.col("nth")).alias("n"))
    out: dict[str, list[bytes]] = {lang: [] for lang in counts}
    left = dict.fromkeys(counts, most_bytes)
    for lang, _, text, n in sorted(drawn.collect(), key=lambda r: (r[0], r[1], bytes(r[2]))):
        for _ in range(n):
            if left[lang] > 0:
                out[lang].append(bytes(text[: left[lang]]))
                left[lang] -= len(text)
    return {lang: texts for lang, texts in out.items() if texts}


_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def prediction_column(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """``struct(lang_pred, score)`` of a text; the model's size is bounded by its sample, so it is broadcast."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> pa.Array:
        raw = [t.as_buffer().to_pybytes() if t.is_valid else None for t in texts.cast(pa.large_binary())]
        labels, scores = shared.value.predict(raw)
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    predict.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(predict, _RESULT)(text)


def identify_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: LanguageModel | None = None
) -> DataFrame:
    """One row per input row: ``id_col, held_out, lang_pred, score``.

    ``lang_pred`` is a learned language, or ``und`` with score 0 where the text is null or has no
    letter (or nothing could be learned). The score is the posterior of the prediction under equal
    priors. Only the text takes part in a prediction. Repeated rows give repeated results; a null id is
    held out; texts are read whole however long; extra columns are ignored; an empty table gives an empty result.
    """
    model = model or LanguageModel.fit(training_sample(docs, id_col, text_col, lang_col))
    found = prediction_column(docs.sparkSession, model, F.col(text_col))
    rows = docs.select(F.col(id_col), held_out_column(id_col).alias("held_out"), found.alias("found"))
    return rows.select(id_col, "held_out", "found.lang_pred", "found.score")


def keep_identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = 0.5
) -> DataFrame:
    """``docs`` without the rows whose language cannot be told: ``und``, or a posterior below ``least_score``.

    Null, empty and letterless texts are ``und``. Where no row is labelled nothing is learned and nothing is
    rejected: all rows stay. All columns are kept, whatever they are called; repeated rows are judged alike;
    texts are read whole however long; an empty table stays empty.
    """
    model = LanguageModel.fit(training_sample(docs, id_col, text_col, lang_col))
    if not model.languages:
        return docs
    (found,) = fresh(docs, "__language")
    rows = docs.withColumn(found, prediction_column(docs.sparkSession, model, F.col(text_col)))
    return rows.where((F.col(f"{found}.lang_pred") != UNDETERMINED) & (F.col(f"{found}.score") >= least_score)).drop(found)
