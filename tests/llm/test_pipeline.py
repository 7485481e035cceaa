import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import pii, quality

DATA = "/root/testdata/sf0.001"


def test_pipeline_against_its_plain_version(spark):
    """Each stage's decision, made again row by row from the stages' own brute-force definitions."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    ids = sorted(rows)
    tail = model.probabilities(model.score([quality.features(rows[i]) for i in ids]))[:, -1]
    kept = [i for i, p in zip(ids, tail, strict=True) if p >= quality.KEEP]

    def shingles(t):
        w = t.encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, first = {i: shingles(rows[i]) for i in kept}, {}
    for i in kept:
        near = [first[j] for j in first if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        first[i] = min(near, default=i)
        for j in first:
            if first[j] in near:
                first[j] = first[i]
    kept = [i for i in kept if first[i] == i]

    def words(t):
        return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) > 127 else " " for c in t).split(" ") if w]

    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1)}
    lengths = {len(w) for w in windows}
    leaks = lambda w: any(tuple(w[i : i + n]) in windows for n in lengths for i in range(len(w) - n + 1))
    kept = [i for i in kept if not leaks(words(rows[i]))]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert sorted(got) == kept and len(kept) < len(ids)
    replaced = {r["doc_id"]: r["text"] for r in pii.replace_pii(docs.filter(docs["doc_id"].isin(kept))).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i in kept:
        assert got[i]["ids"] == library.encode(replaced[i], add_special_tokens=False).ids and got[i]["round_trip"]


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = docs.limit(5).unionByName(spark.createDataFrame([(None, None, None, None, None), (7, "", "en", "s", 0), (7, "", "en", "s", 0)], docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, DATA)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
        out.count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_rows_are_judged_by_their_own_text(spark):
    """Different texts under null and reused ids; one of each is a benchmark passage."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    leak = next(r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if len(r["text"].split()) >= 10)
    text = lambda n: " ".join(f"t{n}w{k}" for k in range(30))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (7, text(3)), (7, text(4)), (8, text(4)), (None, text(5)), (5, text(5)), (None, leak), (7, leak + " end")]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").select(*docs.columns)
    key = lambda df: sorted(((r["doc_id"] or 0), r["text"]) for r in df.collect())
    clean = [(0, text(1)), (0, text(2)), (5, text(5)), (7, text(3)), (7, text(4))]
    assert [x for x in key(corpus_pipeline.near_copies_stage(spark, odd, DATA)) if leak not in x[1]] == clean
    left = key(corpus_pipeline.decontamination_stage(spark, odd, DATA))
    assert left == sorted((i or 0, t) for i, t in rows if leak not in t)
