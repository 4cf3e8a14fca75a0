"""The pipeline stage by stage against plain Python, and its registration."""
from collections import Counter, defaultdict

import corpus_pipeline
from tests_llm_helpers import WORD, slow_components, slow_dedup, slow_rules, slow_targets

import __spark_entry__


def test_stages_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    ids = lambda df: Counter(r["doc_id"] for r in df.collect())
    texts = {r["doc_id"]: r for r in docs.collect()}

    def rejected(t):
        n, chars, symbols, dups, repeated = slow_rules(t)
        letters, lines = [c for c in t if c.isalpha()], [x for x in t.split("\n") if WORD.search(x)]
        return (n < 20 or 100 * repeated > 30 * n or 10 * symbols > n or 2 * dups > len(lines) or chars < 2 * n or chars > 15 * n
                or 2 * sum(c.isupper() for c in letters) > len(letters) or 2 * len(letters) < chars)

    want = [i for i, r in texts.items() if not rejected(r["text"])]
    step = corpus_pipeline.keep_quality(spark, docs, sf_dir)
    assert step.columns == columns and ids(step) == Counter(want)
    want = [k[0] for k in slow_dedup([(i, texts[i]["text"]) for i in want]) if k[3]]
    step = corpus_pipeline.drop_copies(spark, step, sf_dir)
    assert step.columns == columns and ids(step) == Counter(want)
    want = sorted({c for _, _, c in slow_components([(i, texts[i]["text"]) for i in want], 5, 80)})
    step = corpus_pipeline.drop_near_copies(spark, step, sf_dir)
    assert step.columns == columns and ids(step) == Counter(want)
    sizes, largest = defaultdict(int), defaultdict(int)
    for i in want:
        n = len(WORD.findall(texts[i]["text"]))
        sizes[texts[i]["source"]] += n
        largest[texts[i]["source"]] = max(n, largest[texts[i]["source"]])
    goal, taken = slow_targets(sizes), defaultdict(int)
    step = corpus_pipeline.mix_sources(spark, step, sf_dir)
    copies = ids(step)
    assert step.columns == columns and set(copies) <= set(want) and max(copies.values()) <= 2
    for i, n in copies.items():
        taken[texts[i]["source"]] += n * len(WORD.findall(texts[i]["text"]))
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in sizes)
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.collect()
    assert Counter(r["doc_id"] for r in rows) == copies
    assert all(r["lossless"] and r["decoded"] == texts[r["doc_id"]]["text"] and r["n_pieces"] == len(r["pieces"]) for r in rows)


def test_pipeline_on_odd_and_empty_tables(spark, edge, empty):
    for docs in (edge.drop("pieces"), empty):
        for _, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = stage(spark, docs, "")
            assert docs.columns[:len(before)] == before
            docs.collect()


def test_queries_are_registered():
    found = __spark_entry__.queries()
    assert [sum(k.startswith(f"op{n}_") for k in found) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in found and {"op5_quality_rules", "op7_exact_dedup", "op11_merkle_manifest", "op13_hard_negatives"} <= set(__spark_entry__.oracle_sql())
