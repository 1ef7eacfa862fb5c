"""Main text of web pages by consensus of the containers on each host.

Every page scores its containers and votes for their generalised paths. Votes are summed
per host and path, the path with most votes wins, and with it every path that holds a
substantial part of the text on most pages that have it. Each page is read again with the
paths of its host; of paths too rare to be listed the page decides itself. A page without
any falls back on its own best container. Votes are combined before the shuffle. Winners are joined to the pages under a salt, since one
host may hold a third of all pages.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from repostrata.llm.common import settle
from repostrata.llm.html_blocks import SUBSTANTIAL, read, scores, shares
from repostrata.llm.html_blocks import extract as text_at
from repostrata.session import pinned

SALTS = 32
RARE = 64
_HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def with_host(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html, host)``; a null or malformed url has the empty host."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def winning_paths(hosted: DataFrame) -> DataFrame:
    """``(host, path, listed)``: what the pages of each host that has any container say of paths.

    A page gives each path its share of the page's score; ``path`` has most votes, ties go to
    the smaller one. ``listed`` holds the paths on at least one of ``RARE`` pages of the host,
    so its length is bounded: ``wins`` says whether a path directly holds a substantial part
    of the text on at least half of the pages that have it.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str], list] = defaultdict(lambda: [0.0, 0, 0])
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = read(source)
                for path, share in scores(page):
                    votes[host, path][0] += share
                for path, share in shares(page).items():
                    votes[host, path][1] += 1
                    votes[host, path][2] += share >= SUBSTANTIAL
                votes[host, ""][1] += 1
            columns = [[h for h, _ in votes], [p for _, p in votes], [round(v[0] * 1e6) for v in votes.values()]]
            columns += [[v[i] for v in votes.values()] for i in (1, 2)]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = ["host", "path", "v", "n", "m"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    cast = hosted.select("host", "html").mapInArrow(vote, "host string, path string, v long, n long, m long")
    summed = pinned(cast.groupBy("host", "path").agg(*[F.sum(c).alias(c) for c in "vnm"]))
    sizes = summed.where("path = ''").select("host", F.col("n").alias("pages"))
    best = F.min(F.when(F.col("v") > 0, F.struct((-F.col("v")).alias("v"), F.col("path").alias("path"))))
    common = F.when(F.col("n") * RARE >= F.col("pages"), F.struct("path", (F.col("m") * 2 >= F.col("n")).alias("wins")))
    voted = summed.where("path <> ''").join(sizes, "host")
    chosen = voted.groupBy("host").agg(best.alias("best"), F.collect_list(common).alias("listed"))
    return chosen.where("best is not null").select("host", F.col("best.path").alias("path"), "listed")


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)``: one row per row of ``pages(page_id, url, html)``.

    ``text`` has the blocks of the article in page order, one per line; it is empty for null
    or empty html and for pages without text. Repeated rows are extracted each; other
    columns are not read. Pages of any length are read whole.
    """
    settle(pages.sparkSession)
    hosted = with_host(pages)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    winners = pinned(winning_paths(hosted)).withColumn("salt", salts)
    salted = hosted.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, path, listed in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                page = read(source)
                known = {entry["path"]: entry["wins"] for entry in listed or []}
                wins = frozenset(p for p, s in shares(page).items() if known.get(p, s >= SUBSTANTIAL))
                text = text_at(page, path, wins)
                if not text:
                    own = scores(page)
                    text = text_at(page, own[0][0]) if own else "\n".join(b[1] for b in page.blocks)
                texts.append(text)
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in hosted.schema}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string"
    joined = salted.join(winners, ["host", "salt"], "left").select("page_id", "url", "html", "path", "listed")
    return joined.mapInArrow(run, schema)
