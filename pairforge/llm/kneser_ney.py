"""Document quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Units are bytes, so one model covers every language and nothing is out of vocabulary.  Counts, continuation counts,
discounts and back-off weights are made by sharded groupings and joins of count tables keyed by n-gram.  The model is dealt to shards
of bounded size by the two bytes before the last, so that all that one n-gram backs off to lies in one shard, and a document's
n-grams are joined with the shards one after the other, each a broadcast hash table.  Values are whole numbers of 2**-24, so sums,
and with them what is rejected, depend neither on the number of shards nor on the order of rows.  Every trusted document is held out
of one model in turn, and documents above a quantile of their own language's held-out ones are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.functions.shared import positions
from pairforge.llm.common import discard, lean, mix, small_side, text_blocks, unused, written

ORDER, FOLDS, QUANTILE, MARGIN, SLACK, LEAST_HELD_OUT = 5, 5, 0.98, 1.25, 2.0, 1
MOST_ROWS, BROADCAST_BYTES = 3 << 20, 16 << 20
PAD, UNIT, NONE = 10, 1 << 24, -(1 << 31)
AT_ONCE = 32 << 20  # bytes of text that meet all shards together, if there are several
SCORE = T.StructType([T.StructField("log_prob", T.LongType()), T.StructField("units", T.LongType())])


def grams(buf: np.ndarray, offs: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each byte, as one number; texts are padded with line feeds in front."""
    padded = np.insert(buf, np.repeat(offs[:-1], order - 1), PAD).astype(np.uint64)
    n = len(padded)
    out = np.zeros(n, np.uint64)
    for k in range(order):
        out[k:] |= padded[: n - k] << np.uint64(8 * k)
    at = np.arange(len(buf)) + (order - 1) * np.repeat(np.arange(1, len(offs)), np.diff(offs))
    return out[at]


def counts(docs: DataFrame, order: int, folds: int = 1) -> DataFrame:
    """(g, c0, c1, ...): how often each n-gram occurs in the texts of each fold.  docs: text, and fold if there are several."""
    names = [f"c{j}" for j in range(folds)]

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, often = np.zeros(0, np.uint64), np.zeros((0, folds), np.int64)

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(np.ascontiguousarray(often[:, j])) for j in range(folds))], names=["g", *names])

        for rows, buf, offs in text_blocks(batches, "text"):
            u, at = np.unique(grams(buf, offs, order), return_inverse=True)
            fold = np.repeat(rows.column(1).to_numpy().astype(np.int64), np.diff(offs)) if folds > 1 else 0
            new = np.bincount(at * folds + fold, minlength=len(u) * folds).reshape(-1, folds)
            keys, back = np.unique(np.concatenate([keys, u]), return_inverse=True)
            both, often = np.concatenate([often, new]), np.zeros((len(keys), folds), np.int64)
            np.add.at(often, back, both)
            if len(keys) > 1 << 19:
                yield batch_of()
                keys, often = keys[:0], often[:0]
        if len(keys):
            yield batch_of()

    some = docs.select("text", "fold") if folds > 1 else docs.select("text")
    found = some.mapInArrow(scan, "g long, " + ", ".join(f"{c} long" for c in names))
    return found.groupBy("g").agg(*(F.sum(c).alias(c) for c in names))


def discounts(n: list[int]) -> list[float]:
    """The three discounts from the numbers of n-grams seen 1, 2, 3 and 4 times.

    0.75 where they cannot be estimated or come out as nothing: a context without any discount would leave no
    probability for what has not been seen after it.
    """
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    out = []
    for k in range(3):
        d = k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.0
        out.append(d if 0.0 < d <= k + 1 and n[0] and n[1] else 0.75)
    return out


def _units(x: Column) -> Column:
    return F.rint(x * float(UNIT)).cast("long")


def train(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """The model as rows (kind, k, g, v0): kind 0 log probability of the last byte of g after the others, kind 1 log back-off weight of
    context g, both in units of 2**-24.

    k is the n-gram's length, for kind 1 the context's length plus one.
    """
    return train_counted(written(counts(docs, order), "ngrams"), order)


def train_counted(ngrams: DataFrame, order: int = ORDER) -> DataFrame:
    """The models of texts whose n-grams are counted: (kind, k, g, v0, v1, ...), one value for each of the columns c0, c1, ...,
    null where that model lacks the n-gram.  They share every grouping and join."""
    n = len(ngrams.columns) - 1
    models = range(n)
    c, p, s, y, v, below = ([f"{x}{j}" for j in models] for x in ("c", "p", "s", "y", "v", "below"))
    tables, made = {order: ngrams}, []
    for k in range(order - 1, 0, -1):
        low = F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1))
        tables[k] = written(tables[k + 1].groupBy(low.alias("g")).agg(*(F.count_if(F.col(x) > 0).alias(x) for x in c)), "ngrams")
        made.append(tables[k])
    rows, lower = None, None
    for k in range(1, order + 1):
        seen = tables[k].agg(*(F.count_if(F.col(x) == i).alias(f"{x}_{i}") for x in c for i in (1, 2, 3, 4))).first()
        d = [discounts([seen[f"{x}_{i}"] for i in (1, 2, 3, 4)]) for x in c]
        t = tables[k].withColumn("h", F.shiftright("g", 8)).withColumn("low", F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
        mass = lambda j: F.count_if(F.col(c[j]) == 1) * d[j][0] + F.count_if(F.col(c[j]) == 2) * d[j][1] + F.count_if(F.col(c[j]) > 2) * d[j][2]  # noqa: E731, B023
        contexts = t.groupBy("h").agg(*(F.sum(x).alias(z) for x, z in zip(c, s, strict=True)), *(F.when(F.sum(c[j]) > 0, mass(j) / F.sum(c[j])).alias(y[j]) for j in models))
        t = t.join(contexts, "h")
        if lower is not None:
            t = t.join(lower.select(F.col("g").alias("low"), *(F.col(x).alias(z) for x, z in zip(p, below, strict=True))), "low")
        cut = lambda j: F.when(F.col(c[j]) == 1, d[j][0]).when(F.col(c[j]) == 2, d[j][1]).otherwise(d[j][2])  # noqa: E731, B023
        value = lambda j: F.when(F.col(c[j]) > 0, (F.col(c[j]) - cut(j)) / F.col(s[j]) + F.col(y[j]) * (F.lit(1 / 256) if lower is None else F.col(below[j])))  # noqa: E731, B023
        lower = written(t.select("g", *(value(j).alias(p[j]) for j in models)), "ngrams")
        made.append(lower)
        own = lower.select(F.lit(0).alias("kind"), F.lit(k).alias("k"), "g", *(_units(F.log(x)).alias(z) for x, z in zip(p, v, strict=True)))
        back = contexts.select(F.lit(1).alias("kind"), F.lit(k).alias("k"), F.col("h").alias("g"), *(_units(F.log(x)).alias(z) for x, z in zip(y, v, strict=True)))
        rows = own.union(back) if rows is None else rows.union(own).union(back)
    model = written(rows, "model")
    discard(*made)
    return model


class Table:
    """Open addressing: numbers of rows for 64-bit keys, looked up for whole arrays; keys are distinct and not 0."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(2.5 * len(keys) + 1).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        slot, left = mix(keys) & self.mask, np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == 0
            mine = left[free]
            self.keys[slot[mine]] = keys[mine]
            won = mine[self.keys[slot[mine]] == keys[mine]]
            self.rows[slot[won]] = won
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for none."""
        out = np.full(len(keys), -1, np.int32)
        left, slot = np.arange(len(keys)), mix(keys) & self.mask
        while len(left):
            here = self.keys[slot]
            hit = here == keys[left]
            out[left[hit]] = self.rows[slot[hit]]
            on = ~hit & (here != 0)
            left, slot = left[on], (slot[on] + np.uint64(1)) & self.mask
        return out


def _key(kind: int, k: int, g: np.ndarray) -> np.ndarray:
    return (np.uint64(1 + 2 * k + kind) << np.uint64(57)) | g


def shard_of(pair: "np.ndarray | Column", shards: int) -> "np.ndarray | Column":
    """The shard of n-grams with these two bytes before the last."""
    return pair * 40503 % 65536 % shards


class Model:
    """One shard of the models' rows, and those of fewer than three bytes; a column of values each model, NONE where it lacks the row."""

    def __init__(self, kind: np.ndarray, k: np.ndarray, g: np.ndarray, values: np.ndarray) -> None:
        self.order, self.values = int(k.max(initial=1)), values
        self.table = Table(_key(kind.astype(np.uint64), k.astype(np.uint64), g.view(np.uint64)))

    def _find(self, keys: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.table.find(keys)
        value = self.values[row, model] if len(self.values) else np.full(len(row), NONE)
        found = (row >= 0) & (value != NONE)
        return np.where(found, value, 0), found

    def log_probs(self, g: np.ndarray, model: np.ndarray) -> np.ndarray:
        """Of the last byte of each n-gram, under the model of that number."""
        out, left = np.zeros(len(g), np.int64), np.arange(len(g))
        for k in range(self.order, 0, -1):
            now = g[left] & np.uint64((1 << 8 * k) - 1)
            value, found = self._find(_key(0, k, now), model[left])
            out[left] += value
            left, now = left[~found], now[~found]
            value, _ = self._find(_key(1, k, now >> np.uint64(8)), model[left])
            out[left] += value
            if not len(left):
                return out
        out[left] += round(np.log(1 / 256) * UNIT)
        return out


def _dealt_out(model: DataFrame, most_rows: int) -> list:
    """The models' shards as broadcasts of at most about `most_rows` rows."""
    names = [c for c in model.columns if c.startswith("v")]
    beyond = reduce(lambda x, y: x | y, (F.abs(c) >= 1 << 31 for c in names))
    n, wrong = model.agg(F.count("*"), F.count_if(beyond)).first()
    if wrong:
        raise ValueError("the model holds probabilities of zero")
    shards = max(1, -(-n // most_rows))
    pair = F.when(F.col("kind") == 0, F.shiftright("g", 8)).otherwise(F.col("g")).bitwiseAND(F.lit(0xFFFF))
    rows = model.select(F.col("kind").cast("byte").alias("kind"), F.col("k").cast("byte").alias("k"), "g", *(F.coalesce(c, F.lit(NONE)).cast("int").alias(c) for c in names))
    parts = []
    for shard in range(shards):
        m = (rows.where((F.col("k") < 3) | (shard_of(pair, shards) == shard)) if shards > 1 else rows).toArrow()
        values = np.empty((m.num_rows, len(names)), np.int32)
        for j, c in enumerate(names):
            values[:, j] = m.column(c).to_numpy()
        parts.append(model.sparkSession.sparkContext.broadcast(Model(*(m.column(c).to_numpy() for c in ("kind", "k", "g")), values)))
        del m, values
    return parts


def score(docs: DataFrame, model: DataFrame, out: str, order: int = ORDER, most_rows: int = MOST_ROWS, which: str | None = None, parts: list | None = None) -> DataFrame:
    """docs with a column `out`: struct(log_prob in units of 2**-24, units) of the text by one of the models; null texts have no units.

    The column `which` numbers each document's model, the first without it.  Each of the models' shards is a broadcast of at most about
    `most_rows` rows; where there are several, a worker holds one at a time.  parts: the broadcasts of an earlier call with this model.
    """
    parts = parts or _dealt_out(model, most_rows)
    shards = len(parts)
    docs = docs.withColumn(out, F.lit(None).cast(SCORE))
    held_bytes = AT_ONCE if shards > 1 else 0
    where = docs.columns.index(which) if which else None

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scored(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            totals = [np.zeros(len(offs) - 1, np.int64) for _, _, offs in held]
            for shard, part in enumerate(parts):
                table = part.value
                for total, (rows, buf, offs) in zip(totals, held, strict=True):
                    g = grams(buf, offs, order)
                    own = rows.column(where).to_numpy() if which else np.zeros(rows.num_rows, np.int32)
                    own = np.repeat(own, np.diff(offs))
                    values = np.zeros(len(g) + 1, np.int64)
                    if shards > 1:
                        mine = np.flatnonzero(shard_of(((g >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64), shards) == shard)
                        values[mine + 1] = table.log_probs(g[mine], own[mine])
                    else:
                        values[1:] = table.log_probs(g, own)
                    np.cumsum(values, out=values)
                    total += values[offs[1:]] - values[offs[:-1]]
                if shards > 1:
                    del table
                    part.__dict__.pop("_value", None)  # read again for the next texts
            for total, (rows, _, offs) in zip(totals, held, strict=True):
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.StructArray.from_arrays([pa.array(total), pa.array(np.diff(offs))], ["log_prob", "units"])], names=rows.schema.names)

        held: list[tuple] = []
        for block in text_blocks(batches, "text"):
            held.append(block)
            if sum(len(buf) for _, buf, _ in held) >= held_bytes:
                yield from scored(held)
                held = []
        if held:
            yield from scored(held)

    out_docs = docs.mapInArrow(scan, docs.schema)
    out_docs._shards = parts  # for who wants to destroy them when the rows are written
    return out_docs


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled good and not toxic, by every label that they have."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    by = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(F.coalesce(good, F.lit(False))).alias("_good"))
    return written(by.where("_good").select("_id"), "trusted")


def quantiles(held: DataFrame, key: str, value: str, quantile: float) -> DataFrame:
    """(key, value): of each key's n values the one at place ceil(quantile * n) in ascending order, exactly; no task sees all of a key."""
    placed = positions(held.select(key, value), [key, value], [key], "_at")
    n = small_side(written(held.groupBy(key).agg(F.count("*").alias("_n")), "counts"), BROADCAST_BYTES)
    return placed.join(n, key).where(F.col("_at") == F.greatest(F.ceil(F.col("_n") * quantile) - 1, F.lit(0))).select(key, value)


def judged(docs: DataFrame, labels: DataFrame, out: str, order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN, slack: float = SLACK, least: int = LEAST_HELD_OUT, most_rows: int = MOST_ROWS) -> DataFrame:
    """docs with a column `out`: struct(log_prob, units, perplexity, threshold, rejected).

    The trusted documents are dealt to folds (by hash of the id), and each fold is scored by a model of the others; a language's
    (null: a language of its own) threshold is `margin` times the `quantile` of the perplexities that its trusted documents get
    so, however few they are; short texts vary more and get exp(slack / sqrt(bytes)) times as much.  Languages with fewer than
    `least` trusted documents have no threshold and all of their documents pass, as do texts without bytes.  All documents are dealt to folds, and each is
    scored by the model without its own, so no trusted one by a model that has seen it.  Rows with null or repeated ids are judged like all others, and other columns pass unchanged,
    whatever their names; an empty table gives none, and without labels nothing is rejected.
    """
    lang, mark, limit, fold = unused(docs, "lang_of", "score", "limit", "fold_of")
    ids = small_side(trusted_ids(labels), BROADCAST_BYTES)
    dealt = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(FOLDS)).cast("int")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", F.coalesce("lang", F.lit("")).alias(lang)).join(ids, "_id", "left_semi").withColumn("fold", dealt("_id"))
    counted = written(counts(texts, order, FOLDS), "ngrams")
    total = reduce(lambda x, y: x + y, (F.col(f"c{j}") for j in range(FOLDS)))
    others = counted.select("g", *((total - F.col(f"c{j}")).alias(f"c{j}") for j in range(FOLDS)))  # model j leaves out fold j
    model = train_counted(others, order)
    discard(counted)
    part = score(texts, model, "_s", order, most_rows, "fold")
    held = written(part.where("_s.units > 0").select(lang, _perplexity("_s").alias("_ppl")), "held-out")
    few = held.groupBy(lang).count().where(F.col("count") < least).select(lang)
    per = quantiles(held.join(few, lang, "left_anti") if least > 1 else held, lang, "_ppl", quantile).select(lang, (F.col("_ppl") * margin).alias(limit)).distinct()
    scored = score(docs.withColumn(fold, dealt("doc_id")), model, mark, order, most_rows, fold, part._shards).withColumn(lang, F.coalesce("lang", F.lit("")))
    joined = scored.join(small_side(written(per, "thresholds"), BROADCAST_BYTES), lang, "left")
    ppl = F.when(F.col(f"{mark}.units") > 0, _perplexity(mark))
    threshold = F.col(limit) * F.exp(slack / F.sqrt(F.greatest(f"{mark}.units", F.lit(1))))
    made = F.struct((F.col(f"{mark}.log_prob") / float(UNIT)).alias("log_prob"), F.col(f"{mark}.units").alias("units"), ppl.alias("perplexity"), threshold.alias("threshold"), F.coalesce(ppl > threshold, F.lit(False)).alias("rejected"))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), made.alias(out))


def _perplexity(score: str) -> Column:
    return F.exp(-F.col(f"{score}.log_prob") / float(UNIT) / F.col(f"{score}.units"))


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, rejected) of each document.

    Every row gives one, null and repeated ids included; null and empty texts have no perplexity and are not rejected; other columns are
    ignored; an empty table gives none.
    """
    q = judged(docs.select("doc_id", "text", "lang"), labels, "_q", **options)
    return q.select("doc_id", "lang", F.col("_q.units").alias("n_bytes"), F.round("_q.perplexity", 4).alias("perplexity"), F.round("_q.threshold", 4).alias("threshold"), F.col("_q.rejected").alias("rejected"))


def without_rejected(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, unchanged, in every case that `judged` lists."""
    (name,) = unused(docs, "quality_of")
    return judged(docs, labels, name, **options).where(~F.col(f"{name}.rejected")).drop(name)
