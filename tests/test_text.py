import random
import re

import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F

from pubweave.functions.columns import category_names
from pubweave.functions.text import clean_text, phrases_found, words
from pubweave.functions.vocabulary import (
    BY_TAG_STOPWORDS,
    CATEGORY_LABELS,
    CLEANER_STOPWORDS,
    OVERALL_STOPWORDS,
    SNOWBALL_STOPWORDS,
    TOPIC_KEYWORDS,
    distinct_keywords,
)
from pubweave.operators.classify import (
    classify_data,
    keyword_scores,
    keywords_present,
)

WORD_CHARACTER = r"[^\W]"


def papers(spark, *abstracts):
    rows = [(str(i), text) for i, text in enumerate(abstracts)]
    return spark.createDataFrame(rows, "id string, abstract string")


def tags(spark, *abstracts):
    return values(classify_data(papers(spark, *abstracts)).orderBy(F.col("id").cast("int")), "tag")


def best_tag(abstract):
    """Keyword by keyword, the slow way."""
    best, best_score = "other", 0.0
    for tag, keywords in TOPIC_KEYWORDS.items():
        score = 0.0
        for keyword in keywords:
            if re.search(rf"(?<!\w){keyword}(?!\w)", abstract.lower()):
                score += len(keyword) * 0.1
        if score > best_score:
            best, best_score = tag, score
    return best


def random_abstracts(n, seed=7):
    rng = random.Random(seed)
    keywords = distinct_keywords(TOPIC_KEYWORDS)
    gaps = [" ", " ", " ", "  ", "-", "\n", ", ", "é", "_", "x", "(", ""]
    filler = ["the", "log", "event", "of", "müller", "data", "privacy", "42", "c2"]
    for _ in range(n):
        pool = rng.choices(keywords, k=rng.randint(0, 6)) + rng.choices(filler, k=4)
        rng.shuffle(pool)
        text = "".join(
            (w.upper() if rng.random() < 0.2 else w) + rng.choice(gaps) for w in pool
        )
        yield text


def test_sizes_of_the_vocabulary():
    assert len(TOPIC_KEYWORDS) == 16
    assert sum(map(len, TOPIC_KEYWORDS.values())) == 386
    assert len(distinct_keywords(TOPIC_KEYWORDS)) == 384
    assert len(CATEGORY_LABELS) == 72
    assert len(set(SNOWBALL_STOPWORDS)) == 175
    assert len(set(OVERALL_STOPWORDS)) == 208
    assert len(set(BY_TAG_STOPWORDS)) == 217
    assert len(set(CLEANER_STOPWORDS)) == 134


def test_snowball_list_is_sparks_without_fragments(spark):
    from pyspark.ml.feature import StopWordsRemover

    fragments = {"can", "just", "don", "now", "s", "t"}
    assert set(SNOWBALL_STOPWORDS) == (
        set(StopWordsRemover.loadDefaultStopWords("english")) - fragments
    )


def test_classify_edge_rows(spark):
    assert tags(
        spark, None, "", "nothing here", "lateral movement", "adversary cipher aes",
        "log log log malware", "public  key", "public-key", "log_x", "MALWARE!",
        "differential privacy", "caféaes", "naïve aes",
    ) == [
        "other", "other", "other", "Attack Vector", "Cryptography", "Malware",
        "other", "other", "other", "Malware", "Privacy Protection", "other",
        "Cryptography",
    ]


def test_classify_matches_keyword_by_keyword_search(spark):
    abstracts = list(random_abstracts(2000))
    expected = [best_tag(text) for text in abstracts]
    assert len(set(expected)) == 17
    assert tags(spark, *abstracts) == expected


def test_keywords_present_matches_keyword_by_keyword_search(spark):
    abstracts = list(random_abstracts(500, seed=11))
    found = {(r.id, r.keyword) for r in keywords_present(papers(spark, *abstracts)).collect()}
    expected = {
        (str(i), keyword)
        for i, text in enumerate(abstracts)
        for keyword in distinct_keywords(TOPIC_KEYWORDS)
        if re.search(rf"(?<!\w){keyword}(?!\w)", text.lower())
    }
    assert found == expected


def test_keyword_scores(spark):
    rows = keyword_scores(papers(spark, "a cipher, aes; the adversary", "none", None))
    assert {(r.id, r.tag, r.score) for r in rows.collect()} == {
        ("0", "Threat Actor", 0.9), ("0", "Cryptography", 0.6000000000000001 + 0.30000000000000004),
    }


def test_own_topics_with_nested_keywords(spark):
    topics = {"A": ["x", "x y", "x y z"], "B": ["c++ code"]}
    df = papers(spark, "x y z", "x y", "c++ code")
    found = df.select("id", F.array_sort(F.array_distinct(
        phrases_found(F.col("abstract"), topics))).alias("f"))
    assert {r.id: r.f for r in found.collect()} == {
        "0": ["x", "x y", "x y z"], "1": ["x", "x y"], "2": ["c++ code"],
    }
    assert {r.id: r.tag for r in classify_data(df, topics).collect()} == {
        "0": "A", "1": "A", "2": "B",
    }


def test_own_topics_with_unusual_characters(spark):
    topics = {
        "A": ["man, in", "log", "log-file", "log-file system", "naïve"],
        "B\tx": ["middle", "c++", "it's", "a\\b", "[x]", "tab\there", "$5"],
    }
    rng = random.Random(3)
    parts = [w for words_ in topics.values() for w in words_] + [
        ",", "-", " ", ".", "file", "system", "x", "man", "_", "é",
    ]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(600)]
    texts += [" ".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(600)]

    def present(text, keyword):
        return re.search(rf"(?<!\w){re.escape(keyword)}(?!\w)", text.lower()) is not None

    found = {
        (r.id, r.keyword)
        for r in keywords_present(papers(spark, *texts), topics=topics).collect()
    }
    expected = {
        (str(i), w) for i, t in enumerate(texts) for ws in topics.values() for w in ws
        if present(t, w)
    }
    assert found == expected
    scores = {
        (r.id, r.tag): r.score
        for r in keyword_scores(papers(spark, *texts), topics=topics).collect()
    }
    for i, text in enumerate(texts):
        for tag, keywords in topics.items():
            total = 0.0
            for w in keywords:
                total += 0.1 * len(w) if present(text, w) else 0.0
            assert scores.get((str(i), tag), 0.0) == pytest.approx(total)


def test_category_labels_with_tabs(spark):
    df = spark.createDataFrame([("a; b\tc; d",)], "codes string")
    labels = {"a": "A\tone\ntwo", "b\tc": "it's"}
    assert values(df.select(category_names(F.col("codes"), labels))) == ["A\tone\ntwo, it's, d"]
    assert values(df.select(category_names(F.col("codes"), {}))) == ["a, b\tc, d"]


def test_classify_replaces_tag_and_keeps_other_columns(spark):
    df = papers(spark, "malware").withColumn("tag", F.lit("old")).withColumn("z", F.lit(1))
    out = classify_data(df)
    assert out.columns == ["id", "abstract", "tag", "z"]
    assert out.first()["tag"] == "Malware"


def test_classify_has_no_shuffle_and_no_python(spark):
    plan = plan_of(classify_data(papers(spark, "malware")).filter("tag <> 'other'"))
    assert "Exchange" not in plan and "Python" not in plan
    # The filter on the tag must not carry the extraction into a second place.
    assert plan.count("regexp_extract_all") == 1


def test_words(spark):
    df = papers(spark, "Müller naïve don't f1 <b>Bold</b>text 日本 éa\nnext")
    kept = values(df.select(F.explode(words(F.col("abstract"))).alias("w")).filter(
        F.col("w").rlike("^[a-z]{3,}$")))
    assert kept == ["don", "boldtext", "next"]


def test_tags_do_not_span_lines(spark):
    df = papers(spark, "one <two\nthree> four <five> six")
    assert values(df.select(F.array_join(words(F.col("abstract")), " "))) == [
        "one two three four six"
    ]


def test_clean_text(spark):
    df = papers(spark, "The <i>Deep</i>-learning model: 42 a1 x-ray, and  results\n2.5", None)
    assert values(df.select(clean_text(F.col("abstract")))) == [
        " deep-learning  a1 -ray  results", None,
    ]


def test_countable_words(spark):
    from pubweave.functions.text import countable_words

    rng = random.Random(2)
    parts = ["abc", "ab", "ABC", "a1", "é", "日", "_", " ", "-", "\n", "<b>", "<", ">", "42", "İ", "ß"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, ""]], "abstract string")
    both = df.select(
        countable_words(F.col("abstract")).alias("found"),
        F.filter(words(F.col("abstract")), lambda w: w.rlike("^[a-z]{3,}$")).alias("expected"),
    )
    assert both.filter("not found <=> expected").count() == 0


def test_clean_text_equals_word_by_word_cleaning(spark):
    rng = random.Random(4)
    parts = ["the", "The", "a", "x", "7", "42", "deep", "-", "--", " ", "  ", "\n", "\t", ".", ",",
             "é", "naïve", "٣", "<i>", "<", "of", "_", "日本", " ", "9th"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(1500)]
    stops = set(CLEANER_STOPWORDS)

    def cleaned(text):
        kept = re.sub(r"<[^>\n\v\f\r]*>", "", text.lower())
        kept = "".join(c for c in kept if c.isalnum() or c.isspace() or c == "-")
        word = r"(?<![^\W_])([^\W_]+)(?![^\W_])"
        kept = re.sub(word, lambda m: "" if len(m[1]) == 1 or m[1].isdigit() else m[1], kept)
        kept = re.sub(r"\s+", " ", kept).strip(" ")
        return re.sub(word, lambda m: "" if m[1] in stops else m[1], kept)

    df = spark.createDataFrame(list(enumerate(texts)), "id int, abstract string")
    found = {r.id: r.c for r in df.select("id", clean_text(F.col("abstract")).alias("c")).collect()}
    assert found == {i: cleaned(t) for i, t in enumerate(texts)}
    phrase = df.limit(1).select(clean_text(F.lit("use e-mail of it, et al here"), ["et al", "of"]))
    assert phrase.first()[0] == "use -mail  it  here"
