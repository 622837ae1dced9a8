"""Text, rule, key, vector and bibliography functions on hand-worked values."""

import numpy as np
from pyspark.sql import functions as F

from libsight.functions import bibliography, blocks, keys, rules, text as tx, vectors


def value(spark, column, **row):
    fields = row or {"x": 1}
    return spark.createDataFrame([tuple(fields.values())], list(fields)).select(column.alias("v")).collect()[0].v


def test_tokens_and_cjk(spark):
    assert value(spark, tx.estimate_tokens("t"), t="hello world") == 3
    assert value(spark, tx.estimate_tokens("t"), t="深度学习") == 3
    assert value(spark, tx.has_cjk("t"), t="abc中") is True
    assert value(spark, tx.lex_tokens("t"), t="Deep-RL 深度学习 x a1") == ["deep", "rl", "a1", "深度", "度学", "学习"]
    assert value(spark, tx.lex_count("t"), t="Deep-RL 深度学习 x a1") == 6


def test_clamp_tokens_is_the_longest_prefix(spark):
    for text in ("word " * 50, "深度学习" * 30 + "abc" * 20, "short", "😀" * 40):
        got = value(spark, tx.clamp_tokens("t", 20), t=text)
        if got == text:
            assert value(spark, tx.estimate_tokens("t"), t=text) <= 20
            continue
        kept = got.removesuffix("\n…[truncated]")
        assert text.startswith(kept)
        assert value(spark, tx.estimate_tokens("t"), t=kept) <= 20
        assert value(spark, tx.estimate_tokens("t"), t=text[:len(kept) + 1]) > 20


def test_sentences(spark):
    cases = {"See Fig. 3 for it. Then stop! Really? Yes": ["See Fig. 3 for it.", "Then stop!", "Really?", "Yes"],
             "As in Smith et al. 2020 it holds. Next": ["As in Smith et al. 2020 it holds.", "Next"],
             "第一句。第二句！ 第三句": ["第一句。", "第二句！", "第三句"]}
    for text, want in cases.items():
        assert value(spark, tx.split_sentences("t"), t=text) == want


def test_paragraphs_references_markers(spark):
    assert value(spark, tx.split_paragraphs("t"), t="a\nb\n \n\n c \n\n\n") == ["a b", "c"]
    body = "x" * 100
    assert value(spark, tx.drop_references("t"), t=f"{body}\n References \nold") == body
    early = f"ab\nReferences\n{body}"
    assert value(spark, tx.drop_references("t"), t=early) == early
    assert value(spark, tx.page_markers(F.array(F.lit(" a "), F.lit("b")), 3)) == "--- p. 3 ---\na\n\n--- p. 4 ---\nb"


def test_markdown_and_math(spark):
    html = "<h2>A <b>x</b></h2><p>one <strong>two</strong> <em>three</em></p><ul><li><i>i</i> 1</li></ul><a href=\"u\">k</a>"
    assert value(spark, tx.note_markdown("t"), t=html) == "## A x\none **two** *three*\n\n- i 1\n[k](u)"
    math = r"a \( x+1 \) `\(code\)` \[y\]"
    assert value(spark, tx.math_delimiters("t"), t=math) == r"a $x+1$ `\(code\)` $$y$$"
    cited = value(spark, tx.page_citations("t"), t="x (p. 12) y （pp. 4–5） z (p 7)")
    assert [(c.first, c["last"]) for c in cited] == [(12, None), (4, 5), (7, None)]


def test_boolean_query(spark):
    for text, query, want in (("Deep Learning", "deep && learn", True), ("Deep", "deep && x", False),
                              ("Deep", "x || DEEP", True), ("Deep", "", True), ("a", "b ||", True),
                              ("a || b && c", "a || b && c", True), ("abc", "q", False)):
        assert value(spark, rules.matches_query("t", query), t=text) is want


def test_rewrite_rules(spark):
    for rule, text, want in (("A=B", "A cA", "B cB"), ("/a/=x", "banana", "bxnana"), ("/a/g=x", "banana", "bxnxnx"),
                             ("/(b)(a)/=$2$1, n=m", "banana", "abmama"), ("/[/=q", "x/[/y", "xqy"),
                             (r"/(\w)\1/=<$&>", "aabb", "<aa>bb"), ("/^CCF-/=,Q=T", "CCF-Q", "T"),
                             ("/a,b/=c", "a,b", "c"), ("no rule", "x ", "x")):
        assert value(spark, rules.rewrite("t", rule), t=text) == want


def test_tag_picking(spark):
    tags = ["#a/b", "plain", "#", "/unread"]
    picked = value(spark, rules.pick_tags("t", "#"), t=tags)
    assert [(p.tag, p.label) for p in picked] == [("#a/b", "a/b")]
    assert [p.label for p in value(spark, rules.pick_tags("t", "~#"), t=tags)] == ["plain", "/unread"]
    assert [p.label for p in value(spark, rules.pick_tags("t", r"/^#(\w)\/(\w)?/"), t=tags)] == ["a b"]
    assert value(spark, rules.pick_tags("t", "/(/"), t=tags) == []
    assert value(spark, rules.tags_outside("t", "#"), t=tags) == ["plain", "#", "/unread"]
    assert value(spark, rules.tags_outside("t", "", True), t=tags) == tags


def test_keys_and_extra(spark):
    assert value(spark, keys.title_key("t"), t="Déjà Vu: 2!") == "djvu2"
    assert value(spark, keys.title_key("t", unicode=True), t="深度 学习!") == "深度学习"
    assert value(spark, keys.venue_key("t"), t="Proceedings of the  VLDB, 2020") == "vldb 2020"
    assert value(spark, keys.canonical_doi("d", "e"), d="", e="x\nDOI: 10.1/A y") == "10.1/A"
    extra = "a\nlib-rating: 9\nlib-read: 0"
    assert value(spark, keys.rating("e"), e=extra) == 5.0
    assert value(spark, keys.read_mark("e"), e=extra) is False
    assert value(spark, keys.read_mark("e"), e="none") is None
    assert value(spark, keys.write_extra("e", "read", None), e=extra) == "a\nlib-rating: 9"
    assert value(spark, keys.write_extra("e", "read", F.lit("$1")), e=extra) == "a\nlib-rating: 9\nlib-read: $1"
    assert value(spark, keys.position_key(F.lit(3), F.lit(12), F.lit(-4))) == "00003|000012|00000"


def test_vectors(spark):
    v = [((i * 37) % 101 - 50) / 50 for i in range(64)]
    q = value(spark, vectors.quantise("v"), v=v)
    back = [c * q.scale for c in q.codes]
    assert max(abs(a - b) for a, b in zip(v, back)) < 0.01
    assert value(spark, vectors.cosine("a", "b"), a=v, b=back) > 0.999
    assert abs(value(spark, vectors.cosine("a", "b"), a=v, b=[-x for x in v]) + 1) < 1e-9
    assert value(spark, vectors.cosine("a", "b"), a=v, b=[0.0] * 64) == 0.0


def test_bibliography(spark):
    people = F.array(*[F.struct(F.lit(n).alias("lastName"), F.lit("").alias("name")) for n in "ABCDEFG"])
    assert value(spark, bibliography.creator_string(people)) == "A, B, C, D, E, F et al."
    assert value(spark, bibliography.citation(people, F.lit("2020-05"))) == "A et al. 2020"
    args = ("c", "t", "s", "v", "y")
    row = dict(c="A 2020", t=" Long  title", s="", v="", y="2020")
    assert value(spark, bibliography.node_label("shortTitle", *args), **row) == "Long title"
    assert value(spark, bibliography.node_label("venue", *args), **row) == "A 2020"
    assert value(spark, bibliography.rank_tier(F.lit("CCF-B"))) == 2
    record = F.create_map(F.lit("ccf"), F.lit("CCF-A"), F.lit("jcr"), F.lit("Q1"))
    assert value(spark, bibliography.rank_labels(record)) == ["CCF-A"]
    cited = F.create_map(F.lit("Total"), F.lit("5"), F.lit("fetchedAt"), F.lit("x"))
    assert value(spark, bibliography.citation_summary(cited, "Total=T")) == "T 5"
    assert value(spark, bibliography.language_code(F.lit("deepl"), F.lit("zh-TW"), True)) == "ZH-HANT"


def test_blocks(spark):
    yes = ("E = m c^2", "0 1 2 3 4 5 29", "⎧0, When the action ends,")
    no = ("This is a plain sentence about cranes.", "x")
    assert [value(spark, blocks.is_formula("t"), t=s) for s in yes + no] == [True] * 3 + [False] * 2
    for s, want in (("https://doi.org/10.1/x", True), ("mail a.b@uni-x.de now", True), ("12", True),
                    ("1 Department of Physics, University of Rome, Italy", True),
                    ("Work at Mellon University in the past proposed the idea of it", False)):
        assert value(spark, blocks.is_furniture("t"), t=s) is want
    assert value(spark, blocks.looks_like_authors("t"), t="Ada Lovelace, Alan Turing") is True
    long = "the research has drawn attention since mass cus-"
    assert value(spark, blocks.continues_into("a", "b"), a=long, b="tomization grew") is True
    assert value(spark, blocks.join_fragments(F.array("a", "b")), a=long, b="tomization grew").endswith("mass customization grew")
    pieces = value(spark, blocks.split_across("t", F.array(F.lit(1), F.lit(1))), t="One half ends here. The other half too.")
    assert pieces == ["One half ends here.", "The other half too."]


def test_affiliations_end_at_a_full_stop_only(spark):
    from libsight.functions import blocks
    df = spark.createDataFrame([("Work of the University of Rome? Then 00185 Roma, Italy",), ("University of Rome, 00185 Roma. Then we saw it",),
                                ("Keywords : none",)], "t string")
    assert [r[0] for r in df.select(blocks.is_furniture("t")).collect()][:2] == [True, False]
    assert blocks.wide(r"^a\s[\s.]\\s") == rf"^a[{blocks.SPACE}][{blocks.SPACE}.]\\s"


def test_sentences_keep_digits_equal_to_their_position(spark):
    assert value(spark, tx.split_sentences("t"), t="One. 1.2 was 11. 28.68.19.2 left") == ["One.", "1.2 was 11.", "28.68.19.2 left"]


def test_furniture_of_many_names(spark):
    # a loop that takes stack for each name overflows on these
    names = "Anna B.-Lee, " * 20000
    assert value(spark, blocks.is_furniture("t"), t=names + "Cole") is False
    assert value(spark, blocks.is_furniture("t"), t=names + "Cole : A title long enough") is True
    assert value(spark, blocks.is_furniture("t"), t="Anna Lee , Cole: A title long enough") is True
    assert value(spark, blocks.is_furniture("t"), t="Anna Lee, Cole: title not in capitals") is False


def test_upper_keeps_the_number_of_characters(spark):
    assert value(spark, tx.upper("t"), t="Straße, ŉ ᾳß ﬁ zü") == "STRAẞE, ŉ ᾼẞ ﬁ ZÜ"
    assert value(spark, tx.upper("t"), t="zü\n") == "ZÜ\n"


def test_edge_of_a_line_without_width():
    from libsight.operators import layout
    x, r, column = np.array([5.0, 50.0, 50.0]), np.array([5.0, 90.0, 80.0]), np.array([0, 0, 0])
    assert layout._column_edges(x, r, column) == [5.0, 90.0, 90.0]


def test_only_white_space_is_trimmed(spark):
    from libsight.functions import text
    texts = ["\u3000 a \t b\ufeff\n", " c \u0085", "d\u00a0\u2009e", " ", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = rows.select(text.strip("t").alias("s"), text.squeeze("t").alias("q")).collect()
    assert [r.s for r in got] == ["a \t b", "c \u0085", "d\u00a0\u2009e", "", ""]
    assert [r.q for r in got] == [" a b ", " c \u0085", "d e", " ", ""]


def test_title_key_reads_only_the_head(spark):
    text = "\u03b1 - " * 3000 + "Ab-1 " * 40
    plan = spark.createDataFrame([(text,)], "t string").select(keys.title_key("t").alias("k"))
    assert plan.first()["k"] == ("ab1" * 40)[:90]
    assert "regexp_extract" in plan._jdf.queryExecution().optimizedPlan().toString()


def _pieces_by_loop(text, weights):
    total, start, passed, out = sum(weights) or 1, 0, 0, []
    for weight in weights[:-1]:
        passed += weight
        rest = text[start:]
        target = max(1, min(len(rest) - 1, int(passed / total * len(text) + 0.5) - start))
        reach = max(8, int(len(rest) * 0.18 + 0.5))
        marks = [i + 1 for i, ch in enumerate(rest[:-1]) if ch in blocks.BREAK_MARKS and abs(i + 1 - target) <= reach]
        cut = min(marks, key=lambda i: (abs(i - target), i < target), default=target)
        out.append(rest[:cut].strip())
        start += cut
    return out + [text[start:].strip() if len(weights) > 1 else text]


def test_texts_are_cut_without_python(spark):
    import random
    draw = random.Random(3)
    rows = [("".join(draw.choice("ab \n\U0001d11e" + blocks.BREAK_MARKS[:3]) for _ in range(draw.randrange(60))),
             [float(draw.randrange(4)) for _ in range(draw.randrange(5))]) for _ in range(400)] + [(None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "t string, w array<double>").select("t", "w", blocks.split_across("t", "w").alias("p"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for text, weights, got in df.collect():
        assert got == (None if text is None else _pieces_by_loop(text, weights))


def test_kinds_of_texts_without_characters(spark):
    kinds = [blocks.is_formula("t"), blocks.is_furniture("t"), blocks.is_furniture("t", F.lit(True)), blocks.looks_like_authors("t")]
    rows = spark.createDataFrame([(t,) for t in ("", " ", "\u00a0\n", ",", "x = 1 + 2")], ["t"])
    assert [tuple(r) for r in rows.select(*kinds).collect()] == [(False, True, True, False)] * 3 + [
        (False, False, True, False), (True, False, True, False)]
