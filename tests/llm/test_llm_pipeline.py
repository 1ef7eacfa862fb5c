import re

import pytest

import corpus_pipeline
from repostrata.llm import decontaminate, entities, toxicity
from repostrata.llm.common import in_bucket, table

LOWER = {upper: upper + 32 for upper in range(65, 91)}
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        out.append(docs)
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "mixing"]
    assert all(d.schema.simpleString() == stages[0].schema.simpleString() for d in stages[:5])


def test_each_stage_by_brute_force(spark, stages):
    rows = [{r.doc_id: r for r in d.collect()} for d in stages[:5]]
    labels = table(spark, FOLDER, "labels")
    model = toxicity.fit(stages[0], labels, ~in_bucket("doc_id", 4, 2))
    toxic = {r.doc_id for r in toxicity.scores(stages[0], model).where("predicted = 1").collect()}
    assert set(rows[1]) == set(rows[0]) - toxic

    texts = {i: " ".join((r.text or "").translate(LOWER).split()) for i, r in rows[1].items()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    group = {i: i for i in texts}
    links = [(a, b) for a in texts for b in texts if a < b and (texts[a] == texts[b] or (sets[a] and sets[b] and near(a, b)))]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(group[a], group[b])
            changed = changed or group[a] != low or group[b] != low
            group[a] = group[b] = low
    assert set(rows[2]) == set(group.values())

    automaton = decontaminate.Automaton([(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()])
    found = {i: automaton.find((r.text or "").encode()) for i, r in rows[2].items()}
    bad = {i for i, (n, ranges, _) in found.items() if decontaminate.contaminated(n, sum(b - a for a, b in ranges))}
    assert set(rows[3]) == set(rows[2]) - bad

    assert set(rows[4]) == set(rows[3])
    for i, row in rows[3].items():
        seen = entities.find(row.text or "")
        assert (row.text == rows[4][i].text) == (not seen)
        assert all(row.text[m.start : m.end] not in rows[4][i].text for m in seen)

    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows[4].values())
    mixed = stages[5].collect()
    assert abs(sum(r.n_words for r in mixed) - words) <= 64 * len({r.source for r in rows[4].values()})
    assert {i for r in mixed for i in r.doc_ids} <= set(rows[4])


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    key = lambda d: sorted((r.shard, r.slot, r.source, r.block, r.text) for r in d.collect())
    assert key(got) == key(stages[5])
