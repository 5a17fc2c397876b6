"""Operators on single texts: tokens, benchmark windows, classifiers, rules."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import combinations
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from usagemill.llm import bpe, decontaminate, language, queries, toxicity, urls
from usagemill.llm.crf import letter_pieces
from usagemill.llm.word_kernel import WordKernel

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_bpe_is_that_of_the_library(awkward):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    for row in bpe.encoded_report(awkward, PATH).join(awkward.select("doc_id", "text").distinct(), "doc_id").collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["ids"] == ids and row["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_odd_letters():
    library, own = Tokenizer.from_file(PATH), bpe.WordBPE(PATH)
    draw, pool = random.Random(0), [*map(chr, range(0x250)), "\u3000", "\u0301", "Σ", "İ", "中", "😀", "½", "'s", "<|endoftext|>"]
    texts = ["".join(draw.choices(pool, k=draw.randint(0, 30))) for _ in range(2000)] + ["a" * n for n in range(9)]
    ids, begins = bpe._Encoder(own)(texts)
    for i, found in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[begins[i] : begins[i + 1]].tolist() == found.ids, texts[i]


def windows(text, size):
    words = decontaminate.words_of((text or "").encode())
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination(spark, awkward, block):
    long_text = awkward.filter("doc_id = 27").first()["text"].split()
    items = [(1, " ".join(long_text[5:40])), (10, "TWO, words"), (2, ""), (3, None), (None, "one"), (10, " ".join(long_text[30:41])), (4, "ab")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = Counter()
    for row in decontaminate.contamination_report(awkward, benchmark, block_bytes=block).collect():
        got[row["doc_id"], row["n_words"], row["n_hit"], tuple(row["items"]), row["contaminated"]] += 1
    want = Counter()
    for row in awkward.collect():
        words = decontaminate.words_of((row["text"] or "").encode())
        hit, names = set(), set()
        for item, text in items:
            for window in set(windows(text, 10)):
                for i in range(len(words) - len(window) + 1):
                    if tuple(words[i : i + len(window)]) == window:
                        hit.update(range(i, i + len(window)))
                        names.update([] if item is None else [str(item)])
        want[row["doc_id"], len(words), len(hit), tuple(sorted(names)), bool(hit)] += 1
    assert got == want
    clean = decontaminate.decontaminate(awkward, benchmark)
    assert clean.columns == awkward.columns and clean.count() == sum(n for key, n in want.items() if not key[-1])


def test_no_benchmark(spark, awkward, empty):
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination_report(awkward, nothing).filter("contaminated").count() == 0
    assert decontaminate.contamination_report(empty, nothing).count() == 0


def insults(draw, toxic):
    words = ["".join(draw.choices("aehinorst", k=draw.randint(2, 8))) for _ in range(60)]
    if toxic:
        for word in draw.sample(["dumbhead", "scumbag", "vermin"], 2):
            words[draw.randrange(60)] = word
    return " ".join(words)


def test_toxicity_tolerates_inserted_characters(spark):
    draw = random.Random(5)
    rows = [(i, insults(draw, i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    odd = [(1000, "you sc*um*bag and v.e.r.m.i.n here"), (1001, "d u m b h e a d and scumbag"), (1002, ""), (1003, None), (1004, "tea rose one")]
    docs = spark.createDataFrame([row[:2] for row in rows] + odd, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, label) for i, _, label in rows], "doc_id bigint, toxic int")
    found = {row["doc_id"]: row for row in toxicity.toxicity_report(docs, labels).collect()}
    assert all(0 <= row["score"] <= 1 for row in found.values()) and len(found) == len(rows) + len(odd)
    held = [(found[i]["predicted"], label) for i, _, label in rows if found[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [found[i]["predicted"] for i in range(1000, 1005)] == [1, 1, 0, 0, 0]
    assert toxicity.drop_toxic(docs, labels).columns == ["doc_id", "text"]


def chances(model, texts):
    labels = []
    for batch in toxicity._scorer(SimpleNamespace(value=model))([pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["row", "text"])]):
        labels += [int(chance >= 0.5) for chance in batch.column("score").to_pylist()]
    return labels


def test_kernel_has_no_span_and_no_alphabet():
    kernel = WordKernel()
    alike = kernel.gram(["i---d---i---o---t", "i" + "-" * 900 + "diot", "дурак", "дууурак", "笨蛋", "xy", "zebra"], ["idiot", "дурак", "笨蛋", "xy"])
    assert (alike[:2, 0] > 0.6).all() and (alike[2:4, 1] > 0.5).all() and alike[4, 2] > 0.99 and alike[5, 3] > 0.99
    assert alike[6].max() < 0.01
    plain = {}
    word = "abracadabra"
    for i, j, k in combinations(range(len(word)), 3):
        plain[word[i] + word[j] + word[k]] = plain.get(word[i] + word[j] + word[k], 0) + 0.6 ** (k - i - 2)
    numbers, weights = next((numbers, weights) for _, numbers, weights in kernel.features([word]))
    assert WordKernel.norms(numbers, weights)[0] == pytest.approx(sum(value**2 for value in plain.values()) ** 0.5, rel=1e-4)
    long_word = "i" + "a-b" * 200
    pieces = toxicity.words_of(long_word)
    assert all(sum(map(str.isalpha, piece)) <= toxicity.PIECE for piece in pieces)
    # Every run of half a piece is whole in some piece.
    letters = long_word.replace("-", "")
    assert all(any(letters[at : at + toxicity.PIECE // 2] in piece.replace("-", "") for piece in pieces) for at in range(len(letters) - toxicity.PIECE // 2))


def plain_kernel(a, b):
    """All subsequences of three letters, one by one."""

    def features(word):
        places = [i for i, letter in enumerate(word) if letter.isalpha()]
        if len(places) < 3:
            return Counter({"".join(word[i] for i in places): 1.0} if places else {})
        out = Counter()
        for i, j, k in combinations(places, 3):
            out[word[i] + word[j] + word[k]] += 0.6 ** (k - i)
        return out

    f, g = features(a), features(b)
    size = lambda x: sum(value**2 for value in x.values()) ** 0.5
    return sum(f[key] * g[key] for key in f) / (size(f) * size(g)) if f and g else 0.0


def test_kernel_is_that_of_all_subsequences():
    rng = random.Random(6)
    words = ["", "a", "ab", "--", "idiot", "i-d1iot", "übel", "日本語", "aaaa"] + ["".join(rng.choices("abcd-1é", k=rng.randrange(1, 14))) for _ in range(60)]
    found = WordKernel().gram(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert found[i, j] == pytest.approx(plain_kernel(a, b), abs=2e-3), (a, b)


def test_runs_of_letters_cost_no_more_than_words():
    """Text of a script without spaces against as many bytes of words, by the processor's time."""
    import time

    rng = random.Random(1)
    bad = "idiot"
    sample = [(i % 2, toxicity.words_of(" ".join(["".join(rng.choices("abcdefgh", k=5)) for _ in range(30)] + [bad] * (i % 2)))) for i in range(200)]
    model = toxicity.fit(sample)
    spaced = " ".join("".join(rng.choices("abcdefghilmnorst", k=rng.randint(2, 9))) for _ in range(150_000))[:900_000]
    letters = "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(300_000))
    seconds = []
    for text in (spaced, letters):
        start = time.process_time()
        batch = pa.record_batch([pa.array([1]), pa.array([text])], names=["row", "text"])
        list(toxicity._scorer(SimpleNamespace(value=model))(iter([batch])))
        seconds.append(time.process_time() - start)
    assert seconds[1] <= 2 * seconds[0]
    assert model.words([one for one in toxicity.words_of("xkcdxkcdxkcdxkcdxkcdidiotxkcdxkcdxkcd")]).max() > model.words(["xkcdxkcd"]).max()


def test_awkward_rows_are_scored(spark, awkward):
    """A fitted machine on nulls, empty and very long texts, repeated rows and clashing names."""
    rng = random.Random(2)
    text = lambda bad: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(20)) + (" you idiot" if bad else "")
    known = spark.createDataFrame([(10_000 + i, text(i % 2)) for i in range(300)], "doc_id bigint, text string")
    marks = known.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    docs = awkward.unionByName(known, allowMissingColumns=True).withColumn("score", F.lit("x"))
    found = toxicity.score(docs, marks, ["doc_id", "text", "score"]).select("row.doc_id", "row.text", "score").collect()
    assert len(found) == docs.count() and all(0 <= row["score"] <= 1 for row in found)
    by_text = {}
    for row in found:
        assert by_text.setdefault(row["text"] or "", row["score"]) == row["score"]
    assert by_text["idiot"] > by_text["One"] and by_text[""] < 0.5 and by_text["One"] < 0.5


def test_training_reads_sentences_from_all_over_the_text():
    text = " ".join(f"w{i}." for i in range(3 * toxicity.TRAIN_SENTENCES))
    drawn = toxicity._drawn(text).split()
    assert len(drawn) == toxicity.TRAIN_SENTENCES and drawn[0] == "w0." and drawn[-1] == f"w{3 * toxicity.TRAIN_SENTENCES - 3}."
    assert toxicity._drawn("a. b") == "a. b"


@pytest.mark.parametrize("more", [0, 1, 7, toxicity.TRAIN_SENTENCES + 1])
@pytest.mark.parametrize("end", ["", ".", ".\n ", ". rest"])
def test_training_draws_its_full_number_of_sentences(more, end):
    text = ". ".join(f"w{i}" for i in range(toxicity.TRAIN_SENTENCES + more)) + end
    drawn = [line for line in re.split(r"[.\n]", toxicity._drawn(text)) if line.strip()]
    whole = toxicity.TRAIN_SENTENCES + more + end.count("rest")
    assert len(drawn) == min(whole, toxicity.TRAIN_SENTENCES) and drawn[0] == "w0"


def test_toxicity_of_lone_letters_and_many_words():
    assert "idiot" in toxicity.words_of("you i  d\ti\no \r\n t no")[-1]
    words = [f"w{i:05d}" for i in range(1500)]
    batch = pa.record_batch([pa.array([1]), pa.array([" ".join(words)])], names=["toxic", "text"])
    assert next(toxicity._train_words([batch])).column("words").to_pylist() == [words]


def test_toxicity_of_phrases():
    draw = random.Random(3)
    plain = ["".join(draw.choices("aehinorstdlm", k=draw.randint(3, 8))) for _ in range(400)] + ["dirty", "mongrel"]

    def text(toxic):
        words = draw.choices(plain, k=60)
        words = [word for i, word in enumerate(words) if not (i and words[i - 1] == "dirty" and word == "mongrel")] + ["rose"]
        at = draw.randrange(55)
        words[at : at + 2] = ["dirty", "mongrel"] if toxic else draw.choice([["mongrel", "dirty"], ["dirty", "rose"], ["rose", "mongrel"]])
        return " ".join(words)

    sample = [(int(i % 3 == 0), toxicity.words_of(text(i % 3 == 0))) for i in range(600)]
    model = toxicity.fit(sample)
    tests = [(int(i % 3 == 0), text(i % 3 == 0)) for i in range(200)]
    found = chances(model, [text for _, text in tests])
    assert sum(a == b for a, (b, _) in zip(found, tests)) >= 190
    assert chances(model, ["tea d.i.r.t.y mongrel here", "tea dirty here mongrel"]) == [1, 0]


def test_toxicity_without_labels(spark, awkward, empty):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert {row["score"] for row in toxicity.toxicity_report(awkward, labels).collect()} == {0.0}
    assert toxicity.toxicity_report(empty, labels).count() == 0


def test_language(spark):
    draw = random.Random(1)
    kinds = {"aa": "abcdef", "bb": "stuvwx", "cc": "adgsvy"}

    def text(letters, words):
        return " ".join("".join(draw.choices(letters, k=draw.randint(2, 7))) for _ in range(words))

    rows = [(i, text(letters, 30) + " " + text(kinds["aa"], 5), lang) for i, (lang, letters) in enumerate(list(kinds.items()) * 60)]
    odd = [(900, None, "aa"), (901, "12 !?", "aa"), (902, "", None), (903, text("stuvwx", 3000), None)]
    docs = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string")
    found = {row["doc_id"]: row for row in language.language_report(docs).collect()}
    held = [found[i]["lang_pred"] == lang for i, _, lang in rows if found[i]["held_out"]]
    assert sum(held) >= 0.95 * len(held)
    assert [found[i]["lang_pred"] for i in range(900, 904)] == ["und", "und", "und", "bb"]
    assert all(0 <= row["score"] <= 1 for row in found.values())


def test_language_of_long_runs(spark):
    draw = random.Random(2)
    for size in range(1, 200):
        run = "".join(draw.choices("abc", k=size))
        parts = letter_pieces(run)
        assert max(map(len, parts)) <= 24 and parts[0] + "".join(part[3:] for part in parts[1:]) == run

    def letters(kind, size):
        return "".join(draw.choices(kind, k=size))

    spaced = [" ".join(letters("abcdef", draw.randint(2, 7)) for _ in range(30)) for _ in range(100)]
    glued = [letters("的一是不了人我在", 400) + "。" + letters("的一是不了人我在", 90) for _ in range(100)]
    mixed = letters("abcdef", 24) + letters("的一是不了人我在", 4000) + letters("abcdef", 24) + " abc fade bad"
    rows = [(i, text, lang) for i, (text, lang) in enumerate([(text, "aa") for text in spaced] + [(text, "zh") for text in glued])]
    docs = spark.createDataFrame(rows + [(900, mixed, None)], "doc_id bigint, text string, lang string")
    found = {row["doc_id"]: row["lang_pred"] for row in language.language_report(docs).collect()}
    assert found[900] == "zh" and all(found[i] == lang for i, _, lang in rows)


def test_language_of_empty_tables(empty):
    assert language.language_report(empty).count() == 0


def judged(url):
    """Host, path and rule by plain code."""
    _, mark, rest = (url or "").partition("://")
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut]) if mark else ""
    tail = rest[cut:] if mark else ""
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fit = []
    for rule in queries.RULES:
        name, _, start = rule.text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
            fit.append(rule)
    return host, path, max(fit, key=lambda rule: len(rule.text), default=None)


def test_urls(spark):
    list_ = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x://y", "http://example.org/en/12", "http://example.org/en/2#t"]
    list_ += ["http://myexample.org/es/", "http://org/", "http://x.com/fr/2", "http://x.com/de/3", "https://com/de/", "http://x.org", "http://É.com/de/"]
    list_ += [f"http://{'spam-' * (i % 2)}s{i}.example.{('org', 'com', 'net')[i % 3]}/{('es', 'de', 'en')[i % 3]}/{i}" for i in range(90)] + ["http://x.com/de/3"]
    pages = spark.createDataFrame([(i, url, "h", "r") for i, url in enumerate(list_)], "page_id bigint, url string, host string, rule string")
    found = {row["page_id"]: row for row in urls.judge_urls(pages, queries.RULES).collect()}
    assert len(found) == len(list_)
    for i, url in enumerate(list_):
        host, path, rule = judged(url)
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule and rule.text)
        assert found[i]["verdict"] in ("allow", "block") and (rule is None or found[i]["verdict"] == rule.verdict)


def test_urls_with_nothing_to_learn(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (2, None)], "page_id bigint, url string")
    assert {row["verdict"] for row in urls.judge_urls(pages, queries.RULES).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), queries.RULES).count() == 0


def test_hot_url_changes_no_verdict(spark):
    """More copies of one ruled URL than the trees are fitted on, and a very long URL."""
    ruled = [f"http://s{i}.example.{('org/es', 'com/fr')[i % 2]}/{'1' * (i % 9)}x{i}" for i in range(400)]
    other = [f"http://s{i}.example.{('org/en/9', 'net/es', 'com/it')[i % 3]}/{'1' * (i % 9)}x{i}" for i in range(100)] + ["http://n.net/" + "a1/" * 100_000]
    plain_ = spark.createDataFrame(list(enumerate(ruled + other)), "page_id bigint, url string")
    hot = spark.range(20_001).select((F.col("id") + 1000).alias("page_id"), F.lit(ruled[0]).alias("url"))
    verdicts = lambda pages: {row["page_id"]: (row["verdict"], row["chance"]) for row in urls.judge_urls(pages, queries.RULES).filter("page_id < 1000").collect()}
    without = verdicts(plain_)
    assert len({verdict for verdict, _ in without.values()}) == 2
    assert verdicts(plain_.unionByName(hot).repartition(7)) == without


def test_own_label_is_left_out_of_the_rates(spark):
    rows = spark.createDataFrame([("http://a.x/", "a.x", "/", 1.0), ("http://b.x/", "b.x", "/", 0.0)], "url string, host string, path string, blocked double")
    counts = urls.suffix_counts(rows.union(rows))
    rated = {row["host"]: row for row in urls._rates(rows, counts, 0.5, F.lit(1.0)).collect()}
    # Of the two URLs under "x" each sees the other only.
    assert rated["a.x"]["f_rate1"] == (0 + 0.5 * urls.PRIOR) / (1 + urls.PRIOR) and rated["b.x"]["f_rate1"] == (1 + 0.5 * urls.PRIOR) / (1 + urls.PRIOR)
    assert rated["a.x"]["f_rate2"] == rated["b.x"]["f_rate2"] == 0.5


def test_urls_agree_with_sql(spark):
    """Host, path and rule of all pages by DuckDB."""
    import duckdb

    folder = "/root/testdata/sf0.01"
    cases = " ".join(
        f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{rule.text}'"
        for rule in sorted(queries.RULES, key=lambda rule: -len(rule.text))
        for name, _, rest in [rule.text.partition("/")]
    )
    want = duckdb.sql(rf"""
        SELECT page_id, host, path, CASE {cases} END AS rule FROM (
          SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM '{folder}/pages.parquet')""").fetchall()
    got = queries.op8_urls(spark, folder).select("page_id", "host", "path", "rule").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
