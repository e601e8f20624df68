"""Other columns, whatever their names, pass through every operator; documents may be empty, null, very long or repeated."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hopweave.llm import bpe, decontaminate, jaccard, lines, quality, quotes, rules, secrets, toxicity, urls

ODD = ["__key", "__key2", "__id", "__text", "__removed", "__places", "__other0", "a.b", "a`b", "key", "node", "h", "site", "line", "t", "f0", "c0", "k0", "k", "score", "one", "level", "__url", "up", "place"]
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with clashing columns, each holding its own name and the row's number."""
    shared = "one line on all sites there are"
    rows = [(i, f"{shared}\nown words of page {i} " + " ".join(f"w{i}x{j}" for j in range(60)), "en", f"s{i % 14}") for i in range(42)]
    rows += [(50, rows[3][1], "en", "s1"), (51, None, None, None), (52, "", "de", "s2"), (53, "long " * 40000, "en", "s3"), (None, rows[4][1], "en", "s4"), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(2)
    number = F.xxhash64("doc_id").cast("string")
    return df.select("*", *[F.concat(F.lit(f"{n} "), number).alias(n) for n in ODD])


def whole(out, odd, kept=lambda names: names):
    """The columns that were there before are there, in their order, with what they held."""
    assert [c for c in out.columns if c in odd.columns] == kept(odd.columns)
    names = [c for c in ODD if c in kept(odd.columns)]
    plain = out.select("doc_id", *[F.col("`" + c.replace("`", "``") + "`").alias(f"v{i}") for i, c in enumerate(names)])
    for r in plain.collect():
        assert [r[f"v{i}"].rsplit(" ", 1)[0] for i in range(len(names))] == names
        assert len({r[f"v{i}"].rsplit(" ", 1)[1] for i in range(len(names))}) == 1
    return out


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(42)], "doc_id long, quality int, toxic int").coalesce(1)


def test_models(odd, labels):
    for module, column in ((toxicity, "toxic"), (quality, "quality")):
        keep = [c for c in odd.columns if c not in ("text", "score")]
        out = module.score(odd, module.train(odd, labels), keep)
        assert out.columns == [*keep, "score"]
        assert out.count() == odd.count()
    assert whole(toxicity.without_toxic(odd, labels), odd).columns == odd.columns


def test_secrets_and_tokens(odd):
    keep = [c for c in odd.columns if c != "text"]
    assert whole(secrets.find_secrets(odd, keep), odd, lambda names: [c for c in names if c != "text"]).count() == odd.count()
    coded = bpe.encode(odd, RANKS, public_tokenizers.PATTERN, keep)
    back = bpe.decode(coded, RANKS)
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back.select("doc_id", "text").collect()) == sorted((r["doc_id"] or -1, r["text"] or "") for r in odd.select("doc_id", "text").collect())
    whole(back, odd, lambda names: [c for c in names if c != "text"] + ["text"])


def test_rules_and_lines(odd):
    assert whole(rules.filtered(odd), odd).columns == odd.columns
    out = lines.without_boilerplate(odd, removed="cut")
    assert whole(out.drop("cut"), odd).count() == odd.count()
    assert out.filter("cut = 1").count() == 46


def test_near_duplicates_and_benchmark(odd, spark):
    assert whole(jaccard.without_near_duplicates(odd), odd).columns == odd.columns
    bench = spark.createDataFrame([(7, "own words of page 9 w9x0 w9x1 w9x2 w9x3 w9x4 w9x5")], "item_id long, text string")
    kept = whole(decontaminate.decontaminated(odd, bench), odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 9").count() == 0 and kept.count() == odd.count() - 1
    assert [r["a.b"] for r in decontaminate.contaminated(odd, bench, keep="a.b").collect()] == [r["a.b"] for r in odd.filter("doc_id = 9").collect()]


def test_quotes_and_urls(odd):
    talk = odd.withColumns({"conv_id": F.lit(1).cast("long"), "turn": F.col("doc_id")})
    out = quotes.unquoted(talk)
    whole(out.drop("place"), odd, lambda names: [c for c in names if c != "place"])
    assert out.count() == odd.count()
    pages = odd.withColumn("url", F.concat(F.lit("http://a.net/"), F.col("doc_id").cast("string")))
    judged = urls.judged(pages)
    whole(judged.drop("score"), odd, lambda names: [c for c in names if c != "score"])
    assert judged.count() == odd.count()


def test_pipeline_stages(odd, spark):
    small = "/root/testdata/sf0.001"
    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        whole(out, odd)
