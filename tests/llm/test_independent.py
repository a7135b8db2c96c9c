"""Results recomputed by plain, independent code, and cases of bounds and inputs."""

import math
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import common, decontam, html_paths, langid, mixing, quality, toxicity


def test_mix_targets_and_draws(spark):
    """Targets with caps that cascade, in exact fractions, and what documents take from the tree's draws."""
    rng = random.Random(8)
    rows = [(i, "word " * rng.randint(1, 60), s) for i, s in enumerate(["a"] * 30 + ["b"] * 300 + ["c"] * 150 + ["d"] * 3 + [None] * 40)]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    got = {r.doc_id: r for r in mix.documents().collect()}
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (5, 2, 1, 5, 2), strict=True))
    left, free, want = Fraction(3 * sum(sizes.values()), 2), set(sizes), {}
    while over := [s for s in free if left * weights[s] / sum(weights[x] for x in free) > 2 * sizes[s]]:
        for s in over:
            want[s] = Fraction(2 * sizes[s])
        free -= set(over)
        left -= sum(want[s] for s in over)
    want |= {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
    assert len([s for s in want if want[s] == 2 * sizes[s]]) >= 2
    taken = dict.fromkeys(sizes, 0)
    for i, t, s in rows:
        assert got[i]["size"] == len(t.split()) and got[i].source_size == sizes[s] and math.isclose(got[i].target, want[s]) and got[i].taken in (0, got[i]["size"], 2 * got[i]["size"])
        taken[s] += got[i].taken
    assert all(abs(taken[s] - want[s]) <= max(1, 0.02 * want[s]) for s in sizes), (taken, want)
    drawn = {}
    for r in mix.draws().collect():
        drawn.setdefault((r.sid, r.block), []).append(r.edge)
    assert all(len(x) <= 2 and sum(x) <= 1 for x in drawn.values())


def test_a_boundary_of_very_long_documents():
    assert mixing.fill(np.array([1e7, 2e7, 3e7, 5.0] * 10), np.ones(40), 4.1e7).any()


def test_language_scores_are_the_sums_of_backed_off_words(spark):
    docs = [("en", "the house of the king"), ("de", "das haus und der könig"), ("fr", "la maison et le roi")]
    model = langid.Model(docs)
    for text in ("the kings house", "könige", "la maisonnette, 12 rois", "xyz"):
        total = np.zeros(3)
        words = re.findall(r"[a-zö]+", text)
        for w in words:
            if w in model.words:
                total += model.words[w]
                continue
            for size in (4, 3, 2, 1):
                source = f"^{w}$" if size > 1 else w
                seen = [model.grams[size][g] for g in (source[i : i + size] for i in range(len(source) - size + 1)) if g in model.grams[size]]
                if seen:
                    total += sum(seen) / len(seen) * size / 4
                    break
        p = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        lang, score = langid.Scorer(model).score(text)
        assert lang == model.languages[int(np.argmax(p))] and score == pytest.approx(p.max(), abs=1e-9)
    odd = spark.createDataFrame([(1, "²½ Ⅷ"), (2, "½"), (3, "x² y")], "doc_id bigint, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(odd, model).collect()}[1] == "und"
    assert langid.words_of("Ab²cd é1") == ["ab", "cd", "é"]


def test_toxicity_is_the_highest_window(spark):
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32), 0.3, 0.7, -0.2)
    scorer = toxicity.Scorer(model)
    for text in ("", "one", "a b c d e f g", " ".join(f"w{i % 7}x{i}" for i in range(40))):
        words = re.findall(r"[a-z0-9]+", text)
        value = [float(np.mean([model.weight[k] for k in toxicity.subwords(w)])) for w in words]
        size = min(toxicity.WINDOW, len(value))
        top = max((sum(value[i : i + size]) / size for i in range(len(value) - size + 1)), default=0.0) if value else 0.0
        assert scorer.score(text) == pytest.approx(1 / (1 + math.exp(-(0.7 * (top + 0.3) - 0.2))), abs=1e-6)


def test_em_equals_one_over_rows():
    """Expectation-maximisation over pattern counts is that over the rows themselves."""
    rng = np.random.default_rng(4)
    truth = rng.random(600) < 0.7
    # As the prior has it, a fault is seldom found in a good document.
    rows = np.stack([np.where(rng.random(600) < 0.2, 0, np.where(rng.random(600) < np.where(truth, 0.02, 0.7), -1, 1)) for _ in range(4)], 1)
    patterns, back, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    post, _, prior = quality.em(patterns, counts)
    each, _, prior_of_rows = quality.em(rows, np.ones(600))
    assert post[back.ravel()] == pytest.approx(each, abs=1e-4) and prior == pytest.approx(prior_of_rows, abs=1e-4)
    assert ((each > 0.5) == truth).mean() > 0.9


def test_benchmark_of_several_blocks(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(f"i{k}", " ".join(word() for _ in range(25))) for k in range(12)] + [(None, "quite another tiny one here")]
    texts = [" ".join(word() for _ in range(10)) + " " + (items[k % 13][1] if k % 2 else "") for k in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, items[0][1]), (7, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    one, kept = rows(decontam.find_contamination(docs, bench)), rows(decontam.drop_contaminated(docs, bench))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 600)
    assert len(decontam.blocks_of(bench)) > 2
    assert rows(decontam.find_contamination(docs, bench)) == one and rows(decontam.drop_contaminated(docs, bench)) == kept
    assert sum(r[1] for r in one) >= 30


def test_hits_are_counted_alike_in_parts(monkeypatch):
    index = decontam.Index([(i, "the same passage for all of them, number " + "xyz"[i % 3]) for i in range(30)])
    data, offsets = common.normalised(*common.lowered(pa.array(["so the same passage for all of them, number x it is"] * 3, pa.large_string())))
    whole = decontam.matches(index, data, offsets)
    monkeypatch.setattr(decontam, "EXPAND", 7)
    assert whole and decontam.matches(index, data, offsets) == whole


def test_html_tables(spark, monkeypatch):
    schema = "page_id bigint, url string, html string, text string, n_chars int"
    assert html_paths.extract_main_text(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, "x", 1), (None, "u", "", "x", 1), (2, "u", "<p>Some text, and more.</p>", None, None), (2, "u", "<p>Some text, and more.</p>", None, None)]
    got = html_paths.extract_main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "", 0), (2, "Some text, and more.", 20), (2, "Some text, and more.", 20)]
    body = "".join(f"<p>The committee met, and it agreed on every point of agenda number {i}.</p>" for i in range(6))
    for extra in ('<p class="legal">A legal sentence that belongs to the article, as it says.</p>', '<div class="social-science-notice"><p>Social science says so, in this part of the text.</p></div>'):
        assert "says" in html_paths.extract_text(f"<article>{body}{extra}</article>")
    page = f"<div><nav><a href=/>Home</a></nav><div class=b>{body}</div><div class=foot>Us</div></div>"
    whole = html_paths.extract_text(page)
    monkeypatch.setattr(html_paths, "path_scores", lambda found: (np.arange(len(found)), np.ones(len(found))))
    assert whole.count("committee") == 6 and html_paths.extract_text(page) != whole  # the ratios decide


def test_sizes_of_arrow_batches():
    assert [common.byte_size(x) for x in ("64m", "1g", "8388608", "-1", "512kb")] == [64 << 20, 1 << 30, 8 << 20, -1, 512 << 10]
