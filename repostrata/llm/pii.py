"""Personal data replaced by keyed surrogates that are consistent over the whole corpus.

Mentions are found in every text. Their distinct entities get made-up values by a keyed hash,
of the same type, gender, script and form. The values are checked against each other and
against all entities found; those that clash are drawn again until none does, so different
entities stay different and every mention of one entity reads the same everywhere. Entities
and values are tables joined by shuffles; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from repostrata.llm.common import fresh, keep_rows, settle
from repostrata.llm.entities import find, shaped, surrogate
from repostrata.session import pinned

DEFAULT_KEY = b"replace this key"  # keep your own secret: who has it can redo the mapping
_ENTITY = ["kind", "canon"]


def mentions(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, kind, canon)``: the distinct entities of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds, canons = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for kind, canon in sorted({(m.kind, m.canon) for m in find(text or "")}):
                    rows.append(i)
                    kinds.append(kind)
                    canons.append(canon)
            own = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:2]]
            rest = [pa.array(kinds, pa.string()), pa.array(canons, pa.string())]
            yield pa.RecordBatch.from_arrays([*own, *rest], ["doc_id", "digest", *_ENTITY])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, digest long, kind string, canon string").distinct()


def surrogates(entities: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """``(kind, canon, value)`` with a value of its own for every distinct entity.

    A round draws values for the open entities. A value that is a known entity of its kind,
    has been given before, or is drawn for several (the smallest keeps it) is refused, and
    its entity goes to the next round.
    """

    def draw(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                values = pa.array([surrogate(k, c, attempt, key) for k, c in pairs], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, values], [*_ENTITY, "value"])

        return run

    schema = "kind string, canon string, value string"
    entities = pinned(entities.select(*_ENTITY).distinct())
    taken = entities.select("kind", F.col("canon").alias("value"))
    given, open_, attempt = None, entities, 0
    while True:
        drawn = open_.mapInArrow(draw(attempt), schema).join(taken, ["kind", "value"], "left_anti")
        if given is not None:
            drawn = drawn.join(given, ["kind", "value"], "left_anti")
        won = drawn.groupBy("kind", "value").agg(F.min("canon").alias("canon"))
        won = pinned(won.select(*_ENTITY, "value"))
        given = won if given is None else given.unionByName(won)
        open_ = pinned(open_.join(won, _ENTITY, "left_anti"))
        if open_.isEmpty():
            return given
        attempt += 1


def pseudonymise(docs: DataFrame, key: bytes = DEFAULT_KEY, count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; other columns stay as they were.

    With ``count`` a column of that name holds the number of mentions replaced. Texts without
    personal data, null texts among them, are passed through unchanged. Equal rows are treated
    alike; ids may be null or repeated. A column ``n_chars`` follows the new text.
    """
    settle(docs.sparkSession)
    found = pinned(mentions(docs))
    values = surrogates(found, key)
    digest, pairs, join_id = fresh("digest", docs), fresh("pairs", docs), fresh("join_id", docs)
    chosen = found.join(values, _ENTITY).groupBy("doc_id", "digest").agg(F.collect_list(F.struct(*_ENTITY, "value")).alias(pairs))
    chosen = chosen.withColumnsRenamed({"doc_id": join_id, "digest": f"{digest}_"})
    names, place = list(docs.columns), docs.columns.index("text")

    def has(batch: pa.RecordBatch) -> list[bool]:
        return [bool(t and find(t)) for t in batch.column(place).to_pylist()]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, numbers = [], []
            for text, list_ in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                table = {(p["kind"], p["canon"]): p["value"] for p in list_}
                parts, at, seen = [], 0, find(text)
                for m in seen:
                    parts += [text[at : m.start], shaped(text[m.start : m.end], m.kind, table[m.kind, m.canon])]
                    at = m.end
                texts.append("".join([*parts, text[at:]]))
                numbers.append(len(seen))
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int64())], [*names, number])

    number = count or fresh("n_mentions", docs)
    clean = keep_rows(docs, lambda batch: [not h for h in has(batch)]).withColumn(number, F.lit(0).cast("long"))
    dirty = keep_rows(docs, has).withColumn(digest, F.xxhash64("text"))
    same = dirty["doc_id"].eqNullSafe(chosen[join_id]) & (dirty[digest] == chosen[f"{digest}_"])
    joined = dirty.join(chosen, same).select(*[dirty[c] for c in docs.columns], pairs)
    schema = docs.withColumn(number, F.lit(0).cast("long")).schema
    for field in schema:
        field.nullable = True
    out = joined.mapInArrow(apply, schema).unionByName(clean)
    if "n_chars" in docs.columns:
        changed = F.when(F.col(number) > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return out if count else out.drop(number)
