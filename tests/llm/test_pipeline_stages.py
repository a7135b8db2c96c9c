"""Each stage of the pipeline against brute force: which documents it keeps, none lost beside those it must drop."""

import collections
import itertools
import random
import re
from fractions import Fraction

import pytest

PASSAGE = "a quick passage of the benchmark that nobody should ever train a model on because it tells the answer"


def fixture_rows():
    """(doc_id, text, lang, source, n_chars): clean texts of two invented languages, and planted cases among them."""
    rng = random.Random(11)
    letters = {"en": "abcdefghijklm", "de": "nopqrstuvwxyzäöü"}
    say = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(3, 8))) for _ in range(n))
    texts = {i: say("en" if i % 2 else "de", rng.randint(40, 90)) for i in range(1, 91)}
    texts |= {101: None, 102: "", 103: "12 34 -- 56!", 104: "½ ²"}
    texts |= {111: texts[1].upper(), 112: texts[1], 113: texts[3] + " "}
    for i in range(121, 126):
        texts[i] = f"{texts[5].rsplit(' ', 1)[0]} {say('en', 1)}"
    words = texts[7].split()
    texts[131] = " ".join(words[: len(words) // 2]) + " " + say("en", len(words) // 2)
    for i in range(141, 144):
        texts[i] = f"{say('en', 50)} {PASSAGE.upper() if i == 142 else PASSAGE} {say('en', 50)}"
    texts[151] = f"{say('en', 50)} {PASSAGE[: len(PASSAGE) // 2]} {say('en', 50)}"
    lang = lambda i: "de" if i < 100 and i % 2 == 0 else "en"
    return [(i, t, lang(i), ("a", "a", "b", None)[i % 4], len(t or "")) for i, t in texts.items()]


def identified(rows):
    return [r for r in rows if re.search(r"[^\W\d_]", re.sub("[½²]", "", r[1] or ""))]


def without_copies(rows):
    """Of texts equal but for the case of A-Z, the one of the largest id."""
    last = {}
    for r in sorted(rows):
        last[re.sub("[A-Z]", lambda m: m[0].lower(), r[1])] = r
    return sorted(last.values())


def without_near_copies(rows):
    """The smallest id of each component of pairs whose five-word shingles have a similarity of 0.8 or more."""
    bags = {}
    for r in rows:
        w = r[1].lower().split()
        bags[r[0]] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    root = {i: i for i in bags}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(bags), 2):
        if sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return [r for r in rows if find(r[0]) == r[0]]


def clean_of_passages(rows):
    return [r for r in rows if PASSAGE not in r[1].lower()]


WANT = {"language_id": identified, "exact_dedup": without_copies, "near_dedup": without_near_copies, "decontamination": clean_of_passages}
#: What each stage has to drop at least here, so the brute force itself is seen to find the planted cases.
DROPPED = {"language_id": {101, 102, 103, 104}, "exact_dedup": {1, 111}, "near_dedup": {113, 121, 122, 123, 124, 125}, "decontamination": {141, 142, 143}}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def check_mix(rows, mixed):
    """Copies of whole documents, two at most, whose words come near targets by weight with caps, in exact fractions."""
    copies = collections.Counter(r.doc_id for r in mixed)
    whole = {r[0]: r for r in rows}
    assert all((r.doc_id, r.text, r.lang, r.source, r.n_chars) == whole[r.doc_id] for r in mixed) and max(copies.values()) <= 2
    assert len({(r.doc_id, r["copy"]) for r in mixed}) == len(mixed)
    size, taken = collections.Counter(), collections.Counter()
    for i, text, _, source, _ in rows:
        size[source] += len(text.split())
        taken[source] += len(text.split()) * copies[i]
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), (5, 2, 1), strict=True))
    left, open_, want = Fraction(3 * sum(size.values()), 2), set(size), {}
    while over := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]]:
        want |= {s: Fraction(2 * size[s]) for s in over}
        open_ -= set(over)
        left -= sum(want[s] for s in over)
    want |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    assert all(abs(taken[s] - want[s]) <= max(1, 0.01 * want[s]) for s in size), (taken, want)


@pytest.mark.parametrize("parts", [3])
def test_stages_keep_what_brute_force_keeps(spark, tmp_path, parts):
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = fixture_rows()
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(rows, schema).repartition(parts)
        out = stage(spark, docs, str(tmp_path))
        if name == "mixing":
            check_mix(rows, out.collect())
            continue
        assert out.columns == COLUMNS
        got, want = sorted(tuple(r) for r in out.collect()), sorted(WANT[name](rows))
        assert DROPPED[name] == {r[0] for r in rows} - {r[0] for r in want}, name
        assert got == want, (name, {r[0] for r in got} ^ {r[0] for r in want})
        rows = want
    assert {131, 151, 5, 112} <= {r[0] for r in rows}


def test_stages_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (out.columns == COLUMNS or name == "mixing"), name
