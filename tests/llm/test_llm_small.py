"""Operators on small inputs against brute force, with the awkward cases of every table."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from libsight.llm import (
    chat, classifier, components, fingerprint, jaccard, mixing, packing, pages, rules, substrings,
    tokens, words)
from libsight.llm.queries import vocabulary
from libsight.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, source string, score double, n_words int, key string, found int"


def split(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def corpus():
    """Copies, edits, shared passages, an empty, a null, a long and a wordless text."""
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeéfß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    texts = {}
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    for i in range(120):
        texts[i] = " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 150)))
    for i in range(120, 150):
        base = split(texts[rng.randint(0, 119)])
        for _ in range(rng.randint(0, 6)):
            base[rng.randrange(len(base))] = rng.choice(vocab)
        texts[i] = "  ".join(base).title() if i % 7 == 0 else "\n".join(base)
    for i in range(150, 170):
        texts[i] = " ".join(split(texts[i - 150])[:20]) + " " + passage + " tail " + str(i)
    texts |= {170: "", 171: None, 172: " \n\t", 173: "one", 174: "one", 175: "a b c d", 176: "A b C d",
              177: "x " * 90, 178: "y x " * 60 + "z", 179: texts[150], 180: texts[150],
              181: " ".join(rng.choice(vocab) for _ in range(6000)), 182: " wide gap", 183: passage}
    return texts


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, f"s{i % 4}" if i % 9 else None, 1.0, 3, "k", 4) for i, t in corpus.items()]
    return spark.createDataFrame(rows, DOCS).repartition(5, "doc_id")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_word_blocks_agree_with_regex(corpus):
    import pyarrow as pa
    texts = [*corpus.values()]
    for limit in (1, 500, 1 << 20):
        got = []
        for block in words.blocks(pa.array(texts, pa.string()), limit=limit):
            for i in range(len(block)):
                got.append([block.data[block.starts[k]:block.ends[k]].tobytes().decode()
                            for k in range(block.first[i], block.first[i + 1])])
        assert got == [split(t) for t in texts]
    block = next(words.blocks(pa.array(["a b a b c", "b a b", "ab"])))
    h = block.run_hashes(np.array([0, 2, 1, 5]), np.array([2, 4, 3, 7]))
    assert h[0] == h[1] != h[2] == h[3]
    assert len(set(block.hashes.tolist())) == 4


# --- op1

def test_packing_is_whole_and_fits(spark, docs, corpus, empty):
    rows = packing.pack_documents(docs, (16, 64, 128)).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        if r.bin_id is not None:
            by_bin[r.bin_id].append(r)
    for i, text in corpus.items():
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum(r.n_words for r in pieces) == len(split(text))
        assert [r.start for r in pieces] == [128 * k for k in range(len(pieces))]
    for placed in by_bin.values():
        placed.sort(key=lambda r: r.position)
        at = 0
        for r in placed:
            assert r.position == at
            at += r.n_words
        assert at == placed[0].bin_words <= placed[0].bin_capacity
        assert placed[0].bin_capacity == min(c for c in (16, 64, 128) if c >= at)
    assert packing.pack_documents(empty).count() == 0
    assert packing.pack_documents(docs.union(docs), (64,), window=50).where("n_words > 0").count() == 2 * sum(
        -(-len(split(t)) // 64) for t in corpus.values())


def test_packing_takes_the_fullest_fit():
    assert packing.pack([5, 3, 3, 2], (8,)) in ([(0, 0), (0, 5), (1, 0), (1, 3)],)
    placed = packing.pack([10] * 6 + [6] * 6, (16, 64))
    assert len({b for b, _ in placed}) == 6  # 10 + 6 fill bins of 16 without waste


# --- op2

@pytest.mark.parametrize("length, seed", [(35, 8), (12, 4), (5, 5)])
def test_substrings_equal_brute_force(docs, corpus, length, seed):
    met = Counter()
    for text in corpus.values():
        w = split(text)
        met.update(tuple(w[k:k + length]) for k in range(len(w) - length + 1))
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, length, seed).collect()}
    assert len(got) == len(corpus)
    for i, text in corpus.items():
        w = split(text)
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if met[tuple(w[k:k + length])] > 1:
                gone[k:k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed) == (len(w), sum(gone)), i
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        assert got[i].n_repeats == runs


def test_substring_texts_and_repeated_rows(spark, docs, corpus, empty):
    texts = {r.doc_id: r for r in substrings.remove_repeats(
        docs, 12, 4, with_text=True, others=("doc_id", "source", "n_words", "key")).collect()}
    digests = {r.doc_id: r for r in substrings.remove_repeats(docs, 12, 4).collect()}
    for i, r in texts.items():
        assert hashlib.sha256(" ".join(split(r.kept_text)).encode()).hexdigest() == digests[i].kept_sha256
        if not r.n_removed:
            assert r.kept_text == (corpus[i] or "")
    twice = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "g h")], "doc_id bigint, text string")
    assert sorted(r.n_removed for r in substrings.remove_repeats(twice, 5, 2).collect()) == [0, 6, 6]
    assert substrings.remove_repeats(empty).count() == 0


def test_substrings_of_many_equal_rows(spark):
    """Equal rows share one list of places: time and memory grow with the rows, not with their square."""
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))
    rows = [(None, text)] * 3000 + [(7, text + " tail")] + [(8, "own " + " ".join(f"x{i}" for i in range(60)))]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed) for r in got) == {(None, 400, 400): 3000, (7, 401, 400): 1, (8, 61, 0): 1}


# --- op3

def brute_targets(sizes, weights=(5, 2, 1), cap=3.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s] + 1e-9]
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)


def test_mixing_targets_and_sums(spark, docs, corpus, empty):
    rows = mixing.mix(docs, leaf_rows=8).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        assert r.size == len(split(corpus[r.doc_id])) and r.n_rows == 1 and 0 <= r.copies <= 3
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
    want = brute_targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for source in sizes:
        assert abs(taken[source] - want[source]) <= largest[source]
    again = mixing.mix(docs.repartition(3), leaf_rows=8).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(empty).count() == 0


def test_mixing_caps_and_odd_rows(spark):
    rows = ([(i, "w " * 10, "a") for i in range(20)] + [(100 + i, "w " * 100, "b") for i in range(50)]
            + [(200, None, "c"), (201, "", None), (None, "x y", None), (None, "x y", None)])
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    sizes = Counter()
    for r in got:
        sizes[r.source] += r.size * r.n_rows
    want = brute_targets(sizes)
    assert all(r.target == pytest.approx(want[r.source]) for r in got)
    assert want["a"] == 3 * sizes["a"] and all(r.copies == 3 for r in got if r.source == "a")
    assert [r.n_rows for r in got if r.doc_id is None] == [2]


def test_mixing_rounds_rows_not_groups(spark):
    """Rows that are equal, or differ in their text only, miss the target by less than one document."""
    rows = ([(None, "w " * 10, "a")] * 1000 + [(5, "v " * 7, "b")] * 333 + [(None, f"u{i} " * 10, "b") for i in range(100)]
            + [(i, "x " * (i % 30), "c") for i in range(1000, 1300)] + [(None, None, None)] * 9)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    for wording in (None, F.xxhash64("text")):
        got = mixing.mix(df, leaf_rows=16, wording=wording).collect()
        sizes, taken, largest = Counter(), Counter(), Counter()
        for r in got:
            assert 0 <= r.extra < r.n_rows and r.copies + (r.extra > 0) <= 3
            sizes[r.source] += r.size * r.n_rows
            taken[r.source] += r.size * (r.copies * r.n_rows + r.extra)
            largest[r.source] = max(largest[r.source], r.size)
        want = brute_targets(sizes)
        assert sum(r.n_rows for r in got) == len(rows)
        for source in sizes:
            assert abs(taken[source] - want[source]) <= largest[source]
    assert len(got) > 100 + 300


def test_mixing_tosses_a_coin_for_every_pair(spark):
    """Documents taken per leaf spread as with true coins, over some hundred leaves."""
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"),
                                    (1 + F.col("id") % 97).alias("n")).unionByName(
        spark.range(6000, 12_000).select(F.col("id").alias("doc_id"), F.lit("b").alias("source"), (1 + F.col("id") % 89).alias("n")))
    got = mixing.mix(rows, weights=(2, 1), size=F.col("n"), leaf_rows=40).select(
        "source", "copies", "size", (F.col("target") / F.col("source_size")).alias("rate"),
        F.floor(mixing._unit(F.xxhash64(F.lit(17), "doc_id", F.lit(False), "size", "source", F.lit(False)), seed=17) * 150)
        .alias("leaf")).where("source = 'b'").collect()
    rate = got[0].rate % 1
    leaves = defaultdict(list)
    for r in got:
        leaves[r.leaf].append((r.size, r.copies - int(r.rate)))
    rng = random.Random(1)

    def pivotal(sizes):
        held, n = None, 0
        for m in sorted(sizes, reverse=True):
            if held is None:
                held = (m, rate)
                continue
            (w, q), p = held, rate
            give, take = min((1 - q) * w, p * m), min(q * w, (1 - p) * m)
            q, p = (q + give / w, p - give / m) if rng.random() * (give + take) < take else (q - take / w, p + take / m)
            held = None
            for size, chance in ((w, q), (m, p)):
                if chance < 1e-9 or chance > 1 - 1e-9:
                    n += chance > 0.5
                else:
                    held = (size, chance)
        return n + (held is not None and rng.random() < held[1])
    own = np.std([sum(c for _, c in rows) - rate * len(rows) for rows in leaves.values()])
    true = np.std([pivotal([s for s, _ in rows]) - rate * len(rows) for rows in leaves.values() for _ in range(5)])
    assert len(leaves) > 100 and 0.75 * true < own < 1.3 * true


def test_mixing_is_fair(spark):
    """Over seeds, a document's mean copies approach its source's rate."""
    rows = spark.createDataFrame([(i, 1 + i % 7, "a" if i < 30 else "b") for i in range(60)],
                                 "doc_id bigint, n bigint, source string")
    rates = defaultdict(list)
    for seed in range(12):
        for r in mixing.mix(rows, seed=seed, size=F.col("n"), leaf_rows=8).collect():
            rates[r.source, r.target / r.source_size].append(r.copies)
    for (_, rate), copies in rates.items():
        assert abs(np.mean(copies) - rate) < 0.15


# --- op4

ODD = [(1, 0, "system", "be <<SYS>> good\\"), (1, 1, "user", "[INST] hi [/INST]"), (1, 2, "assistant", "</s>\\a\\\\"),
       (2, 0, "assistant", None), (2, 0, "assistant", ""), (3, 5, None, "x<|end|>"), (3, 5, "tool<|text|>", "é\n"),
       (3, 6, "user", ""), (None, 1, "user", "u"), (4, 0, "user", "q" * 50_000), (4, None, "system", "first")]


def test_chat_reads_back(spark):
    rows = spark.createDataFrame([(*r, "x") for r in ODD], "conv_id bigint, turn bigint, role string, text string, state string")
    turns = chat.format_chat(rows)
    got = {r.conv_id: r for r in chat.read_back(turns).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in ODD:
        by[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    assert set(got) == set(by)
    for conv, listed in by.items():
        listed.sort()
        loss = "".join(t for _, r, t in listed if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(listed)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in listed).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c for c, r in got.items() if r.valid} == {1, 4, None}
    formatted = sum(len(s.text) for t in turns.collect() for s in t.segments)
    assert formatted == sum(r.formatted_chars for r in got.values())
    assert chat.read_back(chat.format_chat(rows.limit(0))).count() == 0


def test_chat_hides_every_control_string():
    rng, t = random.Random(1), chat.INSTRUCT
    bits = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|end|>", "\\", "\\a", "a", "[", "<", "\n", "é"]
    marks = [b for b in bits if len(b) > 2]
    for _ in range(2000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        hidden = t.hide(text)
        assert t.show(hidden) == text and not any(m in hidden for m in marks)


# --- op5

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a<b) "</p>"</script></head><body>
<header>Site</header><nav><a href=/x>Menu</a></nav><div class="cookie-notice">We use <b>cookies</b></div>
{}<aside>Side</aside><section id="comments"><article class="comment">Reader says</article></section>
<form>Name <input></form><footer>&copy; x</footer></body></html>"""


def test_lines_heed_markup():
    body = "<article><header><h1>Head &amp;\n line</h1></header><p>One <i>t</i>wo<br>three<p>four &lt;b&gt; <!-- no --> five<ul><li>six</ul></article>"
    lines = pages.lines_of(PAGE.format(body))
    assert [x.text for x in lines if x.article] == ["Head & line", "One two", "three", "four <b> five", "six"]
    assert pages.main_text(lines, None) == "Head & line One two three four <b> five six"
    cut = pages.lines_of("<body><nav>menu<article><p>kept &amp")
    assert pages.main_text(cut, None) == "kept &"
    assert pages.main_text(pages.lines_of("<p>text <a hr"), None) == "text"
    assert pages.lines_of("") == [] and pages.lines_of("3 < 4")[0].text == "3 < 4"


@pytest.mark.parametrize("source,text", [
    ('<script>if(a<b){x="y"}</script><p>Hello world</p>', "Hello world"),
    ('<style>a<b</style><title>no <b></title><p>seen</p>', "seen"),
    ('<script>never closed <p>gone</p>', ""),
    ('<p class="notice">x<p>prose one</p><p>two</p>', "prose one two"),
    ('<ul><li>one<li class="share">x<li>real</ul><p>prose</p>', "one real prose"),
    ('<li class="share">x<li>real</ul><p>prose</p>', "real prose"),
    ('<div class="layout no-sidebar"><p>Real prose</p></div>', "Real prose"),
    ('<article><div class="ad-free">kept</div><div class="x ad">lost</div></article>', "kept"),
    ('<main><p>said</p><div class="comments"><article>reader comment</article></div><p>more</p></main>', "said more"),
    ('<div class="menu"><b>never closed <article>text</article>', "text"),
    ('<aside>a<div>b</aside>c<div>d</div>', "c d"),
    ('<table><tr><td class="nav">m<td>cell<tr><td>next</table><p>after', "cell next after"),
    ('<head><title>t</title><p>no head end</p>', "no head end"),
    ('<span>in</div> line</span> out', "in line out"),
    ('<svg/><p>a</p><svg><text>b</text></svg><p>c</p>', "a c"),
    ('<a href="#">one<a href="#">two</a> three', "onetwo three"),
    ('<form><input>x</form><dl><dt>a<dd>b<dt class="related">c<dd>d</dl>', "a b d"),
    ("<p>1 < 2 &amp; 3 > 2</p><!-- > --><p>x", "1 < 2 & 3 > 2 x"),
])
def test_lines_of_awkward_markup(source, text):
    """Raw elements, implied ends, compound class names, articles inside what is skipped."""
    assert pages.main_text(pages.lines_of(source), None) == text


def test_lines_of_a_very_long_page():
    deep = "<div>" * 30_000 + "text" + "</div>" * 30_000 + "<p>x" * 30_000 + "<ul><li>" * 5_000
    lines = pages.lines_of(deep)
    assert lines[0].text == "text" and len(lines) == 30_001


def test_differencing_deletes_shared_lines(spark):
    def plain(*lines):
        return "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"
    rows = [(1, "http://h.example/a/1", plain("Welcome", "alpha text of some length", "Imprint here")),
            (2, "http://h.example/a/2?x", plain("Welcome", "beta text, longer than shared lines", "Imprint here")),
            (3, "http://other.example/a/2", plain("Welcome", "gamma")),
            (4, "http://c.example/1", PAGE.format("<article><p>same prose</p></article>")),
            (5, "http://c.example/2", PAGE.format("<article><p>same prose</p></article>")),
            (6, None, None), (7, "", "<article></article>"), (7, "", "<article></article>"),
            (8, "http://d.example/1", plain("copied all of it", "own")),
            (9, "http://d.example/2", plain("copied all of it", "other"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in pages.extract(df).collect())
    assert got == [(1, "alpha text of some length", 25), (2, "beta text, longer than shared lines", 35),
                   (3, "Welcome gamma", 13), (4, "same prose", 10), (5, "same prose", 10), (6, "", 0),
                   (7, "", 0), (7, "", 0), (8, "copied all of it own", 20), (9, "copied all of it other", 22)]
    assert pages.extract(df.limit(0)).count() == 0


def test_boilerplate_of_a_host_goes_from_short_pages(spark, monkeypatch):
    """Unmarked notices longer than the text, and two copies of one text under them."""
    notices = ["Notice of the host, one of three, that every page of it carries " + "x" * 36 + str(i) for i in range(3)]

    def plain(*lines):
        return "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"
    own = {i: f"text number {i} " + chr(97 + i) * 180 for i in range(6)}
    rows = [(i, f"http://h.example/a/{i}", plain(*notices[:2], t, notices[2])) for i, t in own.items()]
    copied = "prose that two pages share " + "p" * 150
    rows += [(10 + i, f"http://h.example/b/{i}", plain(*notices[:2], copied, f"seen {i} times", notices[2])) for i in range(2)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = own | {10: copied + " seen 0 times", 11: copied + " seen 1 times"}
    assert {r.page_id: r.text for r in pages.extract(df).collect()} == want
    monkeypatch.setattr(pages, "broadcast_if_small", lambda table: table)  # as for large tables
    assert {r.page_id: r.text for r in pages.extract(df).collect()} == want


def test_shared_is_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(3)
    for _ in range(400):
        a = [rng.randint(0, 5) for _ in range(rng.randint(0, 14))]
        b = [rng.randint(0, 5) for _ in range(rng.randint(0, 14))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        marks = pages.shared(a, b)
        common = [x for x, m in zip(a, marks) if m]
        assert len(common) == table[-1][-1]
        rest = iter(b)
        assert all(x in rest for x in common)
        lengths = pages._lengths(a, b)
        assert lengths == [row[-1] for row in table]


# --- op6

def brute_base(text):
    w = split(text)
    met = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if met[tuple(w[k:k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if split(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_rule_statistics_equal_brute_force(spark, docs, corpus):
    more = {900: "a b c d e a b c d e x #|<\n\nq\nq\n \nq", 901: "a " * 9, 902: "w\n" * 40, 903: "p q r s t " * 30 + "u v " * 8}
    df = docs.select("doc_id", "text").union(spark.createDataFrame([*more.items()], "doc_id bigint, text string"))
    for r in rules.statistics(df).collect():
        assert tuple(r[c] for c in rules.BASE) == brute_base((corpus | more)[r.doc_id]), r.doc_id


def test_rules_learn_a_list(spark, empty):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = " ".join(rng.choice("abcdefgh") * rng.randint(2, 9) + ("#" if bad and rng.random() < .8 else "") for _ in range(60))
        rows.append((i, text))
        marks.append((i, 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = rules.judge(df, spark.createDataFrame(marks + [(None, 1), (3, None), (10**6, 0)], "doc_id bigint, quality int")).collect()
    good = dict(marks)
    assert sum(r.kept == bool(good[r.doc_id]) for r in got if not r.base_failed) > 0.97 * sum(not r.base_failed for r in got)
    none = rules.judge(df, spark.createDataFrame([], "doc_id bigint, quality int")).collect()
    assert all(r.kept != r.base_failed for r in none)
    assert rules.judge(empty, spark.createDataFrame(marks, "doc_id bigint, quality int")).count() == 0
    plan = rules.statistics(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- op7

def test_tokens_equal_the_library(spark, docs, corpus):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(vocabulary())
    rng = random.Random(2)
    pool = "aAbZé ßİΣσς'sS’\n\t\x1c\x85   ١2½ñ漢字🙂🏽é…!!--<|endoftext|>"
    odd = ["", None, "a" * 5000, "ab" * 3000, "It's we'll THEY'RE", "<|startoftext|>x<|endoftext|><|endoftext|>", "ΟΔΟΣ Σ", "Ａ１ ﬁ",
           *("".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(1500))]
    counter = tokens.Counter(tokens.MergeTable(vocabulary()))
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for t in odd]
    assert counter.counts(odd) == want
    for r in tokens.count_tokens(docs, vocabulary(), keep=("doc_id", "n_words")).collect():
        text = corpus[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)


# --- op8

def brute_components(texts, size=5, percent=75):
    sets = {}
    for i, t in texts.items():
        w = split(lower(t))
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}
    comp = {i: i for i in sets}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_jaccard_components_equal_brute_force(docs, corpus, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_similar(docs).collect()}
    assert got == brute_components(corpus)
    assert jaccard.join_similar(empty).count() == 0


def test_jaccard_chains_bridges_and_low_thresholds(spark):
    """Chains of edits, bridges between groups, many common shingles, short and tied sets."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(40)]
    texts, n = {}, 0
    for _ in range(6):
        w = [rng.choice(vocab) for _ in range(40)]
        for _ in range(25):
            texts[n] = " ".join(w)
            n += 1
            w[rng.randrange(40)] = rng.choice(vocab)
    for size, percent in ((5, 75), (1, 60), (2, 50)):
        df = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_similar(df, size, percent).collect()}
        assert got == brute_components(texts, size, percent)


def test_jaccard_links_short_crops(spark):
    """Crops of 8 to 12 words, many per base text: linked sets share fewer shingles than the widest step."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    texts = {}
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(40)]
        for _ in range(20):
            n = rng.randint(8, 12)
            at = rng.randint(0, 40 - n)
            texts[len(texts)] = " ".join(base[at:at + n])
    df = spark.createDataFrame([*texts.items()], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_similar(df).collect()}
    assert got == brute_components(texts)


def test_jaccard_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "g h i j k l"), (7, "G h i j k l"), (9, None)],
                               "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jaccard.join_similar(df).collect()), key=str)
    assert got == [(5, 5), (5, 5), (7, 5), (9, 9), (None, None)]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (129, 300)]
    with Scratch(spark) as keep:
        got = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint"), keep).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in [*range(100, 130), 300]}


# --- op9

def test_classifier_learns_and_scores_odd_texts(spark, empty):
    rng = random.Random(4)
    good, bad = [f"g{i}" for i in range(50)], [f"b{i}###" for i in range(50)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(30))) for i in range(400)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (1, None)], "doc_id bigint, quality int")
    extra = [(1000, ""), (1001, None), (1002, " \n"), (None, "g1 g2"), (1, rows[1][1]), (1003, "g3 " * 100_000)]
    df = spark.createDataFrame([(*r, 9.0) for r in rows + extra], "doc_id bigint, text string, score double")
    got = classifier.classify(df, marks, keep=("doc_id", "score")).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 for r in got)
    import zlib
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (r.score >= 0.3)
    tested = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == r.doc_id % 2 for r in tested) >= 0.98 * len(tested)
    nothing = classifier.classify(df, marks.limit(0)).collect()
    assert all(r.score == 0.5 for r in nothing)
    assert classifier.classify(empty, marks).count() == 0


def test_classifier_sample_is_one_text_an_id_and_bounded(spark):
    rows = [(i, ("bad### " if i % 2 else "good words ") * 20) for i in range(60)]
    marks = spark.createDataFrame([(i, (i + 1) % 2) for i in range(60)], "doc_id bigint, quality int")
    once = spark.createDataFrame(rows, "doc_id bigint, text string")
    again = spark.createDataFrame(rows * 3, "doc_id bigint, text string").repartition(7)
    weights = classifier.fit(once, marks)
    assert (weights == classifier.fit(again, marks)).all()
    # the sample ends in hash order, however the features come in batches
    few = classifier.fit(once, marks, sample_entries=100)
    assert (few == classifier.fit(once.repartition(9), marks, sample_entries=100)).all() and (few != weights).any()
    assert not classifier.fit(once, marks, sample_entries=0).any()
    # of several texts of an id the one with the least hash
    other = once.unionByName(once.withColumn("text", F.concat("text", F.lit("z"))))
    least = other.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    assert (classifier.fit(other, marks) == classifier.fit(least, marks)).all()


def test_features_equal_per_text_features(corpus):
    """A block of many texts gives each text what a block of its own gives."""
    import pyarrow as pa
    texts = [t or "" for t in corpus.values()][:60] + ["ab###cd AB!! x", "###", "a"]

    def per_text(limit):
        out = []
        for block in words.blocks(pa.array(texts), kind=classifier.TokenBlock, limit=limit):
            i, v, o = classifier.grouped(*classifier.features(block), classifier.BITS)
            out += [list(zip(i[o == k].tolist(), v[o == k].round(9).tolist())) for k in range(len(block))]
        return out
    assert per_text(1) == per_text(1 << 20)


# --- op10

def test_fingerprints_of_edits(spark, docs, corpus, empty):
    got = {r.doc_id: r for r in fingerprint.probe_edits(docs).collect()}
    plain = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    ids = sorted(corpus)
    for n, i in enumerate(ids):
        text, after = corpus[i] or "", corpus[ids[(n + 1) % len(ids)]] or ""
        k = len(text) // 4
        edited = text[:len(text) - k] + after[:k]
        f, e, x = map(fingerprint.fingerprint, (text, edited, after))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprint.show(f) == plain[i] and r.edited_fingerprint == fingerprint.show(e)
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(f, e), fingerprint.likeness(f, x))
    long = [r for r in got.values() if 400 < r.n_chars]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.2
    assert fingerprint.probe_edits(empty).count() == 0
    one = spark.createDataFrame([(None, "abcdefgh")], "doc_id bigint, text string")
    assert fingerprint.probe_edits(one).first().near_next == 1.0


def test_phrases_are_a_lempel_ziv_parse():
    new, rest = fingerprint.phrases("aabababbb", set())
    assert new == ["a", "ab", "aba", "b", "bb"] and rest == ""
    assert fingerprint.likeness(fingerprint.fingerprint(""), fingerprint.fingerprint("")) == 1.0
