"""Many edits, long hosts, and columns that are called like the helpers of an operator."""

import random
import time

import public_tokenizers
from conftest import SMALL
from pyspark.sql import functions as F

from deltascreen.llm import decontamination, quality, secrets, simhash, token_counts, urls
from deltascreen.llm.common import fresh_path

COUNT = token_counts.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
HELPERS = ["_id", "_key", "_cuts", "_rest", "_blob", "_of", "_print", "_row", "_rules", "_best", "rules", "__id"]


def test_many_edits_take_linear_time():
    rng = random.Random(2)
    text = "".join(rng.choice(["word ", "other\n", "some. ", "x"]) for _ in range(700_000))
    places = sorted(rng.sample(range(len(text)), 200_000))
    edits = [(p, p + rng.randint(0, 3), rng.choice(["", "new", " two words "])) for p in places]
    tree = token_counts.CountTree.of(text, COUNT)
    start = time.monotonic()
    new, done, _ = token_counts.apply_edits(text, tree, edits, COUNT)
    assert time.monotonic() - start < 10 and done == len(edits)
    assert tree.total == COUNT(new) and tree.chars[1] == len(new)


def test_hosts_of_many_labels(spark):
    hosts = ["s://" + "a." * 20_000 + "example.org/es/x", "s://" + "b." * 20_000 + "net/"]
    pages = spark.createDataFrame(list(enumerate(hosts)), "page_id long, url string")
    got = {r.page_id: r.rule for r in urls.judge(pages, urls.rule_table(spark)).collect()}
    assert got == {0: "example.org/es/", 1: None}
    assert {r.rule for r in urls.judge(pages, urls.rule_table(spark).limit(0)).collect()} == {None}


def test_columns_called_like_helpers(spark, odd):
    same = lambda df: sorted(map(str, df.select("doc_id", "text").collect()))
    clash = odd.drop("row").withColumns({n: F.lit(i) for i, n in enumerate(HELPERS)})
    bench = spark.createDataFrame([(1, "other words of the same id")], "item_id long, text string")
    labels = spark.createDataFrame([(5, 1), (8, 0), (9, 0)], "doc_id long, quality int")
    steps = [
        lambda d: decontamination.clean(d, bench), lambda d: quality.keep_good(d, labels), lambda d: simhash.keep_one(d),
        lambda d: secrets.redact(d, fresh_path(spark, "ledger")),
    ]
    for step in steps:
        got = step(clash)
        assert got.columns == clash.columns and same(got) == same(step(odd))
        assert {tuple(r) for r in got.select(*HELPERS).collect()} <= {tuple(range(len(HELPERS)))}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").limit(50)
    own = urls.judge(pages.withColumns({"rules": F.lit(1), "_rules": F.lit(2), "_best": F.lit(3)}), urls.rule_table(spark))
    assert {(r.rules, r._rules, r._best) for r in own.collect()} == {(1, 2, 3)}
