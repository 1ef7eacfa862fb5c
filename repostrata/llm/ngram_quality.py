"""Document quality by perplexity under an interpolated modified Kneser-Ney model.

The model is over bytes, of order ``ORDER``, and is counted on all trusted text. An n-gram
of up to seven bytes is packed into a long, so counts, continuation counts, discounts and
back-off weights are exact aggregates and joins over longs, sharded by n-gram.

Scoring does not ship the model to the documents. Each task packs its documents into
compressed frames of at most ``FRAME`` bytes and lists the distinct n-grams of every frame,
sorted and packed, one list per shard. A shard is told by the two bytes before the last: the
n-gram, its shorter tails and all their contexts lie in the same one, so a list meets all the
model it needs at once. What is shorter than that has at most 65,536 values and travels with
the tasks. Only the values a frame asked for, in the order of its lists, meet it again. A frame
that misses one of its n-grams fails the job rather than be misjudged.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame, functions as F

from repostrata.llm.common import as_bytes, settle
from repostrata.session import pinned

ORDER = 5
FRAME = 8 * 1024 * 1024
_PIECE = 1 << 20  # bytes of text worked on at a time
QUANTILE = 0.99
PRIOR = 30  # held-out trusted documents that the common quantile counts for beside a language's own
SHARDS = 256
BLOCK = 1024  # frames whose lists meet one copy of a shard's model
_SMALL = 2  # up to this length n-grams are few enough to travel
_FILTER_WORDS = 1 << 16  # 64-bit words of the filter that spares untrusted text the shuffle


def packed(text: bytes, order: int = ORDER) -> Iterator[np.ndarray]:
    """The n-gram that ends at each byte of a text, as longs; line breaks stand before its first.

    Long texts come in pieces, so memory stays bounded.
    """
    edge = order - 1
    for at in range(0, len(text), _PIECE):
        before = text[max(0, at - edge) : at].rjust(edge, b"\n")
        raw = np.frombuffer(before + text[at : at + _PIECE], np.uint8).astype(np.int64)
        grams = raw[edge:].copy()
        for k in range(1, order):
            grams |= raw[edge - k : len(raw) - k] << (8 * k)
        yield grams


def _grouped(texts: list[bytes], order: int) -> Iterator[np.ndarray]:
    """The n-grams of many texts, in arrays of about ``_PIECE`` numbers."""
    held, size = [], 0
    for text in texts:
        for grams in packed(text, order):
            held.append(grams)
            size += len(grams)
            if size >= _PIECE:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``(gram, n)`` over all rows of ``texts(text)``, added up within tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grams in _grouped(as_bytes(batch.column(0)), order):
                codes, values = pd.factorize(grams)
                counts = np.bincount(codes, minlength=len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], ["gram", "n"])

    raw = texts.select("text").mapInArrow(count, "gram long, n long")
    return raw.groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams seen one to four times."""
    row = counts.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).head()
    n1, n2, n3, n4 = (row[f"n{k}"] or 0 for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.05 * k), 0.95 * k) for k, d in zip((1, 2, 3), raw))


def model_levels(grams: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame | float]]:
    """For lengths ``order`` down to 1: ``(gram, alpha)`` and ``(context, gamma)``.

    ``alpha`` is the discounted probability of a seen n-gram, ``gamma`` the weight that its
    context leaves to the shorter one; single bytes have one context, whose gamma is a number.
    Shorter n-grams count how many bytes they follow.
    """
    levels, counts = [], grams
    for length in range(order, 0, -1):
        counts = pinned(counts)
        d1, d2, d3 = _discounts(counts)
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        sums = [F.sum("n").alias("total"), F.sum(discount).alias("given")]
        if length == 1:
            row = counts.agg(*sums).head()
            share = (F.col("n") - discount) / F.lit(float(row.total or 1))
            levels.append((counts.select("gram", share.alias("alpha")), row.given / row.total if row.total else 1.0))
            break
        context = F.shiftright("gram", 8)
        totals = pinned(counts.groupBy(context.alias("context")).agg(*sums))
        gamma = totals.select("context", (F.col("given") / F.col("total")).alias("gamma"))
        seen = counts.withColumn("context", context).join(totals, "context")
        alpha = seen.select("gram", ((F.col("n") - discount) / F.col("total")).alias("alpha"))
        levels.append((alpha, gamma))
        shorter = F.col("gram").bitwiseAND((1 << 8 * (length - 1)) - 1)
        counts = counts.groupBy(shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    return levels


def _pair_shard(pair):
    """Shard of the two bytes before the last of an n-gram, for arrays and columns."""
    mixed = pair * 40503
    return F.shiftright(mixed.bitwiseAND(65535), 8) if isinstance(mixed, Column) else (mixed & 65535) >> 8


def sharded_model(grams: DataFrame, order: int) -> tuple[DataFrame, dict[tuple[int, str], tuple[np.ndarray, np.ndarray]], float]:
    """The model as ``(shard, length, kind, gram, value)``, what is short as arrays, and the last gamma.

    ``kind`` is ``a`` for alphas and ``g`` for gammas, whose ``gram`` is the context.
    """
    parts, small, last = [], {}, 1.0
    for length, (alpha, gamma) in zip(range(order, 0, -1), model_levels(grams, order)):
        tables = {"a": alpha.select("gram", F.col("alpha").alias("value"))}
        if isinstance(gamma, float):
            last = gamma
        else:
            tables["g"] = gamma.select(F.col("context").alias("gram"), F.col("gamma").alias("value"))
        for kind, table in tables.items():
            if length <= _SMALL:
                found = table.orderBy("gram").toArrow()
                small[length, kind] = tuple(found.column(c).to_numpy() for c in ("gram", "value"))
            else:
                pair = F.col("gram") if kind == "g" else F.shiftright("gram", 8)
                shard = _pair_shard(pair.bitwiseAND(65535)).cast("int").alias("shard")
                parts.append(table.select(shard, F.lit(length).alias("length"), F.lit(kind).alias("kind"), "gram", "value"))
    schema = "shard int, length int, kind string, gram long, value double"
    model = grams.sparkSession.createDataFrame([], schema)
    for part in parts:
        model = model.unionByName(part)
    return model, small, last


def log_probabilities(grams: np.ndarray, tables: dict, last: float, order: int) -> np.ndarray:
    """Natural logarithms of the n-grams' probabilities, from the uniform distribution upwards.

    ``tables`` has sorted n-grams and values by ``(length, kind)``. An unseen context passes
    everything on to the shorter one.
    """

    def value(length: int, kind: str, wanted: np.ndarray, default: float) -> np.ndarray:
        known, values = tables.get((length, kind), (np.empty(0, np.int64), np.empty(0)))
        if not len(known):
            return np.full(len(wanted), default)
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return np.where(known[at] == wanted, values[at], default)

    chance = np.full(len(grams), 1 / 256)
    for length in range(1, order + 1):
        tail = grams & ((1 << 8 * length) - 1)
        weight = last if length == 1 else value(length, "g", tail >> 8, 1.0)
        chance = value(length, "a", tail, 0.0) + weight * chance
    return np.log(chance)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending longs as compressed differences, the equal bytes of all of them together."""
    steps = np.diff(values, prepend=np.int64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_sorted(packed_values: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed_values, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(np.int64).reshape(-1))


def answered(asked: DataFrame, grams: DataFrame, order: int) -> DataFrame:
    """``(frame, n, grams, logs)`` for each list ``(frame, shard, n, grams)``, values in its order."""
    model, small, last = sharded_model(grams, order)
    model = pinned(model)
    blocks = max(1, -(-asked.select("frame").distinct().count() // BLOCK))
    block = F.pmod(F.xxhash64("frame"), F.lit(blocks)).cast("int").alias("block")
    copies = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

    def answer(lists: pa.Table, model: pa.Table) -> pa.Table:
        sizes = lists.column("n").to_pylist()
        wanted = [unpack_sorted(g, n) for g, n in zip(lists.column("grams").to_pylist(), sizes)]
        tables = dict(small)
        lengths, kinds = model.column("length").to_numpy(), np.array(model.column("kind").to_pylist(), object)
        known, values = model.column("gram").to_numpy(), model.column("value").to_numpy()
        for length in range(_SMALL + 1, order + 1):
            for kind in "ag":
                own = np.flatnonzero((lengths == length) & (kinds == kind))
                own = own[np.argsort(known[own])]
                tables[length, kind] = (known[own], values[own])
        logs = [log_probabilities(g, tables, last, order).tobytes() for g in wanted]
        return lists.select(["frame", "n", "grams"]).append_column("logs", pa.array(logs, pa.binary()))

    left = asked.withColumn("block", block).groupBy("shard", "block")
    right = model.withColumn("block", copies).groupBy("shard", "block")
    return left.cogroup(right).applyInArrow(answer, "frame long, n long, grams binary, logs binary")


def trusted_text(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of the documents that ``labels`` calls good (quality 1).

    Ids are joined by a shuffle, whatever their number. A filter of fixed size (512 KB) built
    from the labels drops most other documents before it; what it lets through is decided by
    the join.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    bits = _FILTER_WORDS * 64
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    word = F.shiftright(slot, 6).alias("word")
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {bits}) % 64 as int))")
    rows = good.groupBy(word).agg(F.bit_or(bit).alias("bits")).collect()
    words = np.zeros(_FILTER_WORDS, np.int64)
    words[[r.word for r in rows]] = [r.bits for r in rows]
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            hit = (shared.value[at >> 6] >> (at & 63)) & 1
            yield batch.select([0, 1]).filter(pa.array(hit == 1))

    kind = docs.schema["doc_id"].dataType.simpleString()
    slotted = docs.where("doc_id is not null").select("doc_id", "text", slot.alias("slot"))
    return slotted.mapInArrow(maybe, f"doc_id {kind}, text string").join(good, "doc_id", "left_semi").select("text")


def _frames(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Numbered runs of batches with at most ``limit`` bytes; a longer row is a frame of its own."""
    number, held, size = pyspark.TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        lengths = np.fromiter((len(t) for t in as_bytes(batch.column(1))), np.int64, batch.num_rows)
        start = 0
        for i, length in enumerate(lengths.tolist()):
            if size and size + length > limit:
                held.append(batch.slice(start, i - start))
                yield number, held
                start, number, held, size = i, number + 1, [], 0
            size += length
        held.append(batch.slice(start))
    if held:
        yield number, held


def _distinct(frame: list[pa.RecordBatch], order: int) -> np.ndarray:
    known = np.empty(0, np.int64)
    for batch in frame:
        for grams in _grouped(as_bytes(batch.column(1)), order):
            known = pd.unique(np.concatenate([known, pd.unique(grams)]))
    return known


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = ORDER, frame: int = FRAME) -> DataFrame:
    """``(doc_id, lang, n_tokens, perplexity)`` per row of ``docs``, from the model of ``trusted(text)``.

    Tokens are bytes. Null and empty texts have none and a null perplexity. ``docs`` is read
    twice and has to come out the same, in the same partitions; a table does.
    """
    settle(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in _frames(batches, frame):
            grams = np.sort(_distinct(held, order))
            shard = _pair_shard((grams >> 8) & 65535)
            by = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[by])) + 1
            lists = [grams[own] for own in np.split(by, cuts)] if len(grams) else []
            columns = [
                pa.array([number] * len(lists), pa.int64()), pa.array([_pair_shard((g[0] >> 8) & 65535) for g in lists], pa.int32()),
                pa.array(map(len, lists), pa.int64()), pa.array(map(pack_sorted, lists), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["frame", "shard", "n", "grams"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, held in _frames(batches, frame):
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for batch in held:
                    out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue()], pa.binary())], ["frame", "docs"])

    asked = pinned(rows.mapInArrow(ask, "frame long, shard int, n long, grams binary"))
    answers = answered(asked, gram_counts(trusted, order), order)

    def score(frames: pa.Table, answers: pa.Table) -> pa.Table:
        lists = zip(*(answers.column(c).to_pylist() for c in ("n", "grams", "logs")))
        found = [(unpack_sorted(g, n), np.frombuffer(v)) for n, g, v in lists]
        known, logs = (np.concatenate([f[i] for f in found] or [np.empty(0)]) for i in (0, 1))
        known = known.astype(np.int64, copy=False)
        sort = np.argsort(known)
        known, logs = known[sort], logs[sort]
        out = []
        for payload in frames.column("docs").to_pylist():
            for batch in pa.ipc.open_stream(payload):
                totals, counts = [], []
                for text in as_bytes(batch.column(1)):
                    total = 0.0
                    for wanted in packed(text, order):
                        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                        if not len(known) or (known[at] != wanted).any():
                            raise RuntimeError("the documents changed between two reads of them")
                        total += float(logs[at].sum())
                    counts.append(len(text))
                    totals.append(float(np.exp(-total / len(text))) if text else None)
                columns = [batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(totals, pa.float64())]
                out.append(pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "n_tokens", "perplexity"]))
        return pa.Table.from_batches(out)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, n_tokens long, perplexity double"
    frames = rows.mapInArrow(pack, "frame long, docs binary")
    return frames.groupBy("frame").cogroup(answers.groupBy("frame")).applyInArrow(score, schema)


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``(doc_id, lang, n_tokens, perplexity, threshold, kept)`` per row of ``docs``.

    A document is kept when its perplexity is at most the threshold of its language: the
    ``quantile`` of trusted documents of the language, drawn towards the one over all of them
    as if that came from ``PRIOR`` further documents (a mean of logarithms). So a language with
    few or no trusted documents, or a null one, is judged by the common quantile, and its own
    counts the more the more there are. Those documents are a fifth of the ids, which the model
    has not seen: documents it was counted on look likelier than new ones of the same quality.
    Without trusted documents at all everything with text is kept. Texts without a byte are not
    kept. Repeated rows get equal results.
    """
    seen = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)) != 0
    scored = pinned(perplexities(docs, trusted_text(docs, labels.where(seen))))
    good = labels.where("quality = 1 and doc_id is not null").where(~seen)
    good = good.select(F.col("doc_id").alias("good_id")).distinct()
    trusted = scored.join(good, F.col("doc_id") == F.col("good_id"), "left_semi").where("perplexity is not null")
    cut = F.percentile_approx("perplexity", quantile, 100_000)
    overall = F.lit(trusted.agg(cut.alias("c")).head().c).cast("double")
    by_lang = trusted.where("lang is not null").groupBy(F.col("lang").alias("lang_"))
    n = F.count(F.lit(1))
    shrunk = F.exp((n * F.ln(cut) + PRIOR * F.ln(overall)) / (n + PRIOR))
    rows = scored.join(by_lang.agg(shrunk.alias("cut")), F.col("lang") == F.col("lang_"), "left")
    limit = F.coalesce("cut", overall)
    kept = F.col("perplexity").isNotNull() & (limit.isNull() | (F.col("perplexity") <= limit))
    return rows.select("doc_id", "lang", "n_tokens", "perplexity", limit.alias("threshold"), kept.alias("kept"))
