"""The pipeline against a plain one: each stage on all its predecessor kept."""

import collections
import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from orebed.llm import packing, pii, simhash  # noqa: E402
from tests.llm.test_operators import SCHEMA, check_packing, prose  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rng = random.Random(30)
    rows = []
    for i in range(400):
        rows.append((i, prose(rng, rng.randint(60, 300)), "en", "hot" if i % 3 == 0 else f"s{i % 5}"))
    for i in range(40):  # copies, exact and near
        words = rows[i][1].split()
        if i % 2:
            words[3] = "changed"
        rows.append((500 + i, " ".join(words), "en", "copy"))
    rows += [(600 + i, " ".join(w + "%%%###$" for w in prose(rng, 120).split()), "en", "hot") for i in range(30)]
    rows += [(700 + i, prose(rng, 80) + f" write to user{i}.x@mail.example.com now", "en", "s1") for i in range(10)]
    rows += [(800, None, None, None), (801, "", "en", "s1"), (802, "few words", "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA + ", n_chars long")
    out, folder = [docs], tmp_path_factory.mktemp("stages")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], "").write.parquet(f"file://{folder}/{k}")
        out.append(spark.read.parquet(f"file://{folder}/{k}"))
    return [{"columns": df.columns, "rows": df.collect()} for df in out]


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "PII", "mixing sources", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality_stage(stages):
    kept = {r["doc_id"] for r in stages[1]["rows"]}
    assert set(range(400)) <= kept and not kept & {600 + i for i in range(30)} and not kept & {800, 801, 802}


def test_dedup_stage(stages):
    before, after = stages[1]["rows"], {r["doc_id"] for r in stages[2]["rows"]}
    fps = {r["doc_id"]: simhash.fingerprint(r["text"].encode()) for r in before}
    left, want = set(fps), set()
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            one = todo.pop()
            new = {d for d in left if (fps[d] ^ fps[one]).bit_count() <= 4}
            left -= new
            group |= new
            todo += new
        want.add(min(group))
    assert after == want


def test_personal_data_stage(stages):
    before, find = {r["doc_id"]: r for r in stages[2]["rows"]}, pii.finder(pii.train())
    assert len(stages[3]["rows"]) == len(before)
    for r in stages[3]["rows"]:
        assert (r["text"] == before[r["doc_id"]]["text"]) == (not find(before[r["doc_id"]]["text"])[1])
        assert pii.base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])


def test_mixing_stage(stages):
    before = {r["doc_id"]: tuple(r) for r in stages[3]["rows"]}
    assert all(before[r["doc_id"]] == tuple(r) for r in stages[4]["rows"])
    weight = collections.Counter(r["source"] for r in stages[4]["rows"])
    assert max(weight.values()) < 2.2 * min(weight.values())
    for table in stages[1:5]:
        assert table["columns"] == stages[0]["columns"]


def test_packing_stage(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[4]["rows"]}
    assert check_packing(stages[5]["rows"], texts) < 0.1
    assert sum(r["start"] == 0 for r in stages[5]["rows"]) == len(stages[4]["rows"])
    tool = packing.Encoder(packing.vocabulary_path())
    assert sum(r["length"] for r in stages[5]["rows"]) == sum(len(c) // 4 + 1 for c in tool.texts([r["text"].encode() for r in stages[4]["rows"]]))


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA + ", n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
