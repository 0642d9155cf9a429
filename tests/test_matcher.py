"""Vectors of the verification matcher, and that dealing rows otherwise changes nothing."""

import pytest
from pyspark.sql import functions as F

from attestra.operators import matcher as M

Z3 = ["P<UTODOE<<ANNA<MARIA" + "<" * 24, "L898902C36UTO7408122F1204159ZE184226B<<<<<10"]  # the specimen of the zones' public standard
CASES = [
    (["VORNAMEN / GIVEN NAMES LENA"], {"given_names": "LENA"}, None, {"given_names": ("LENA", "match")}),
    (["NORDHAUSEN KREIS 03.04.1987"], {"birth_place": "3. NORDHAUSEN KREIS", "birth_date": "1987-04-03"}, None, {"birth_place": ("NORDHAUSEN KREIS", "match"), "birth_date": ("03.04.1987", "match")}),
    (["771204558910", "05.06.2011"], {"serial_number": "771204558970", "birth_date": "05.06.2010"}, None, {"serial_number": ("771204558910", "mismatch"), "birth_date": ("05.06.2011", "mismatch")}),
    (["LENA"], {"name": "LENA", "surname": "LENA"}, None, {"name": ("LENA", "match"), "surname": (None, "not_found")}),
    (Z3, {"surname": "DOE", "passport_number": "L898902C3"}, "passport", {"surname": ("DOE", "match"), "passport_number": ("L898902C3", "match")}),
    (["  lindqvist  ", "ASTRIT"], {"surname": "LINDQVIST", "name": "ASTRID"}, None, {"surname": ("lindqvist", "match"), "name": ("ASTRIT", "likely_match")}),
    (["KRI", "STIN"], {"name": "KRISTIN"}, None, {"name": ("KRI STIN", "match")}),
    (["AB", "B7654321"], {"code": "AD", "passport_number": "B7654329"}, None, {"code": ("AB", "mismatch"), "passport_number": ("B7654321", "mismatch")}),
]


def test_vectors(spark):
    lines, fields, types = [], [], []
    for i, (text, want, kind, _) in enumerate(CASES):
        lines += [(f"d{i}", p, x, 0.9) for p, x in enumerate(text)]
        fields += [(f"d{i}", p, k, v) for p, (k, v) in enumerate(want.items())]
        types.append((f"d{i}", kind))
    fields.append(("none", 0, "name", "A"))
    frame = lambda n=None: (spark.createDataFrame(lines, "doc_id string, line_pos int, text string, confidence double"), spark.createDataFrame(fields, "doc_id string, field_pos int, field string, expected string"))
    a, b = frame()
    docs = spark.createDataFrame(types, "doc_id string, document_type string")
    got = {(r.doc_id, r.field): (r.detected, r.status) for r in M.verify(a, b, docs).collect()}
    for i, (_, _, _, want) in enumerate(CASES):
        for f, v in want.items():
            assert got[f"d{i}", f] == v
    assert got["none", "name"] == (None, "not_found")
    again = {(r.doc_id, r.field): (r.detected, r.status) for r in M.verify(a.repartition(5), b.repartition(3), docs).collect()}
    assert again == got


@pytest.mark.parametrize("digits, want", [("740311", "6"), ("AD6632763", "8"), ("<<<", "0"), ("a", None)])
def test_check_digit(spark, digits, want):
    from pyspark.sql import functions as F

    from attestra.functions import mrz

    assert spark.range(1).select(mrz.check_digit(F.lit(digits)).alias("c")).first().c == want


BOXED = "doc_id string, line_pos int, line_id string, text string, confidence double, side string, bbox struct<x1:double,y1:double,x2:double,y2:double>, polygon array<struct<x:double,y:double>>"
FIELD = "doc_id string, field_pos int, field string, expected string"


def test_lines_are_joined_by_their_boxes(spark):
    """In reading order, past lines that do not fit; not over a gap, not between the two sides of a card."""
    lines = [("a", 0, "low", "HOUSE 7", 0.9, None, (12.0, 132.0, 200.0, 146.0), None), ("a", 1, "top", "LONG LANE", 0.8, None, None, [(10.0, 101.0), (240.0, 101.0), (240.0, 116.0), (10.0, 116.0)]), ("a", 2, "far", "OTHER", 0.9, None, (500.0, 110.0, 640.0, 124.0), None)]
    lines += [("b", 0, None, "LONG LANE", 0.9, None, (10.0, 0.0, 200.0, 14.0), None), ("b", 1, None, "HOUSE 7", 0.9, None, (10.0, 300.0, 200.0, 314.0), None)]
    lines += [("c", 0, None, "LONG LANE", 0.9, "front", (0.0, 0.0, 60.0, 10.0), None), ("c", 1, None, "HOUSE 7", 0.9, "back", (0.0, 12.0, 60.0, 22.0), None)]
    lines += [("d", 0, None, "LONG LANE", 0.9, None, None, None), ("d", 1, None, "", 0.9, None, None, None), ("d", 2, None, "HOUSE 7", 0.9, None, None, None)]
    fields = spark.createDataFrame([(x, 0, "address", "8. LONG LANE HOUSE 7") for x in "abcd"], FIELD)
    got = {r.doc_id: r for r in M.verify(spark.createDataFrame(lines, BOXED), fields).collect()}
    assert (got["a"].detected, got["a"].status) == ("LONG LANE HOUSE 7", "match") and all(got[x].status != "match" for x in "bc")
    assert [(e.line_id, e.span, e.source) for e in got["a"].evidence] == [("top", [0, 9], "visible_ocr"), ("low", [0, 7], "visible_ocr")] and got["a"].evidence[0].bbox.x2 == 240.0
    assert got["c"].evidence[0].side in ("front", "back") and got["d"].evidence[0].line_id in ("0", "2")


def test_options_are_the_best_twelve(spark, monkeypatch):
    """Pruning by upper limits, and in several blocks, keeps what comparing all would."""
    import random
    from difflib import SequenceMatcher

    r = random.Random(5)
    word = lambda: "".join(r.choice("ABCDE") for _ in range(r.randint(2, 9)))
    lines = spark.createDataFrame([("d", i, " ".join(word() for _ in range(5)), r.random()) for i in range(25)], "doc_id string, line_pos int, text string, confidence double")
    fields = M.prepared(spark.createDataFrame([("d", i, "name", word() + " " + word()) for i in range(6)], FIELD))
    monkeypatch.setattr(M, "BLOCK", 40)
    cands = M.candidates(lines)
    got = {}
    for x in M.options(fields, cands).collect():
        got.setdefault(x.field_pos, []).append(round(x.score, 9))
    texts = {(x.text, tuple(map(tuple, x.resources))) for x in cands.collect()}
    for f in fields.collect():
        every = sorted((round(SequenceMatcher(None, f.target, t.replace(" ", "")).ratio(), 9) for t, _ in texts), reverse=True)
        assert sorted(got.get(f.field_pos, []), reverse=True) == [v for v in every[:12] if v >= 0.35]
    assert M.work(lines, spark.createDataFrame([("d", 0, "name", "ABBA")], FIELD)).first().candidates == cands.count()


def test_both_sides(spark):
    f, b = (spark.createDataFrame([("d", i, x) for i, x in enumerate(t)], "doc_id string, line_pos int, text string") for t in (["one", "two"], ["three"]))
    assert [(r.line_pos, r.text, r.side) for r in M.both_sides(f, b).orderBy("line_pos").collect()] == [(0, "one", "front"), (1, "two", "front"), (2, "three", "back")]


def test_older_matcher(spark):
    from attestra.operators import line_matcher

    lines = spark.createDataFrame([("d", 0, "LENA"), ("d", 1, "KRI"), ("d", 2, "STIN"), ("d", 3, "07/08/1991"), ("e", 0, "LENA")], "doc_id string, line_pos int, text string")
    fields = spark.createDataFrame([("d", 0, "given", "LENA"), ("d", 1, "surname", "KRISTIN"), ("d", 2, "birth", "07.08.1991"), ("e", 0, "name", "LENA"), ("e", 1, "surname", "LENA")], "doc_id string, field_pos int, field string, expected string")
    got = {(r.doc_id, r.field): (r.detected, r.status) for r in line_matcher.verify(lines, fields).collect()}
    assert got["d", "given"] == ("LENA", "match") and got["d", "surname"] == ("KRI STIN", "match") and got["d", "birth"] == ("07/08/1991", "match")
    assert sorted(v[1] for (d, _), v in got.items() if d == "e") == ["match", "not_found"]


def test_every_line_of_a_turn(spark, tmp_path):
    from attestra.plans import queries as q

    spark.createDataFrame([("c", 0, "u", "say one two three\n\nfour five"), ("c", 1, "u", "six seven eight nine"), ("e", 0, "u", None)], "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    lines, fields = q._turns(spark, str(tmp_path))
    assert [(r.line_pos, r.text) for r in lines.where("doc_id = 'c'").orderBy("line_pos").collect()] == [(1, "say one two three"), (2, ""), (3, "four five"), (4, "six seven eight nine")]
    assert {(r.doc_id, r.field_pos, r.expected) for r in fields.where("doc_id = 'c'").collect()} == {("c", 0, "one two three"), ("c", 1, "seven eight nine")}
    found = M.verify(lines, spark.createDataFrame([("c", 0, "name", "four five")], "doc_id string, field_pos int, field string, expected string")).first()
    assert (found.detected, found.status) == ("four five", "match")


def test_spans_of_long_and_odd_lines(spark):
    import re
    import time

    texts = ["a", "  a\tb  c  ", "　x y", "é " * 7, " ".join(f"w{i % 97}" for i in range(700))]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(texts)], "doc_id string, line_pos int, text string")
    got = {(x.resources[0].line, x.resources[0].a, x.resources[0].b, x.text) for x in M.span_candidates(df).collect()}
    want = {(i, 0, len(x), x.strip()) for i, x in enumerate(texts)}
    for i, x in enumerate(texts):
        at = [m.span() for m in re.finditer(r"\S+", x)]
        want |= {(i, at[j][0], at[k][1], x[at[j][0] : at[k][1]]) for j in range(len(at)) for k in range(j, min(j + 6, len(at)))}
    assert {(i, a, b, re.sub(r"^\s+|\s+$", "", t)) for i, a, b, t in got} == {(i, a, b, t.strip()) for i, a, b, t in want}
    long = spark.createDataFrame([("d", 0, " ".join(f"word{i}" for i in range(8_000)))], "doc_id string, line_pos int, text string")
    M.span_candidates(df).count()
    began = time.time()
    assert M.span_candidates(long).select(F.sum(F.length("text"))).first()[0] > 48_000
    assert time.time() - began < 15


def test_evidence_names_kind_and_side(spark):
    lines = spark.createDataFrame([("d", 0, "LENA", "front", None), ("d", 1, "HOLM", "scan", "back"), ("d", 2, "7 MAY ROAD", None, None)], "doc_id string, line_pos int, text string, source string, side string")
    fields = spark.createDataFrame([("d", 0, "name", "LENA"), ("d", 1, "surname", "HOLM"), ("d", 2, "address", "7 MAY ROAD")], "doc_id string, field_pos int, field string, expected string")
    got = {r.field: [(e.source, e.side) for e in r.evidence] for r in M.verify(lines, fields).collect()}
    assert got == {"name": [("visible_ocr", "front")], "surname": [("visible_ocr", "back")], "address": [("visible_ocr", None)]}


def test_work_is_what_a_direct_count_gives(spark):
    import random

    r = random.Random(11)
    word = lambda: "".join(r.choice("ABC") for _ in range(r.randint(1, 4)))
    lines = spark.createDataFrame([(d, i, " ".join(word() for _ in range(r.randint(1, 4)))) for d in "ab" for i in range(4)] + [("c", 0, "")], "doc_id string, line_pos int, text string")
    expected = spark.createDataFrame([(d, i, "name", v) for d in "ab" for i, v in enumerate(["ABC", "12345678", word(), word() + word()])] + [("c", 0, "name", "ABC"), ("e", 0, "name", "ABC")], FIELD)
    got = {x.doc_id: x for x in M.work(lines, expected).collect()}
    cands, kept = M.candidates(lines), {}
    for x in M.options(M.prepared(expected), cands).collect():
        kept.setdefault((x.doc_id, x.field_pos), []).append((x.rank, x.adjusted, [tuple(s) for s in x.resources]))
    for d, fields in (("a", 4), ("b", 4), ("c", 1), ("e", 1)):
        paths, states, transitions, options = [(0.0, [])], 0, 0, 0
        for f in range(fields):
            some = sorted(kept.get((d, f), []))
            options += len(some)
            transitions += len(paths) * len(some)
            more = [(t + v, used + spots) for t, used in paths for _, v, spots in some if not any(m == n and max(a, p) < min(b, q) for m, a, b in spots for n, p, q in used)]
            paths = sorted(paths + more, key=lambda p: -p[0])[:64]
            states += len(paths)
        n = cands.where(F.col("doc_id") == d).count()
        assert (got[d].fields, got[d].candidates, got[d].comparisons, got[d].options, got[d].states, got[d].transitions) == (fields, n, fields * n, options, states, transitions)
        assert options <= got[d].ratios <= fields * n


def test_plan_reads_lines_few_times(spark, tmp_path):
    """Candidates are not built again for each step that uses them."""
    spark.createDataFrame([("d", 0, "LENA HOLM")], "doc_id string, line_pos int, text string").write.parquet(f"{tmp_path}/lines")
    lines = spark.read.parquet(f"{tmp_path}/lines")
    plan = M.verify(lines, spark.createDataFrame([("d", 0, "name", "LENA")], FIELD))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("line_pos#") and plan.count("Relation [") <= 16


def test_spans_stay_with_their_document(spark, tmp_path):
    """Only lines, fields and options are moved: no exchange above the spans holds them, and no join sorts them."""
    words = spark.range(40).select(F.col("id").cast("string").alias("doc_id"), F.expr("array_join(transform(sequence(0, 299), i -> concat('w', i, 'x', id)), ' ')").alias("text"))
    words.write.parquet(str(tmp_path / "w"))
    lines = spark.read.parquet(str(tmp_path / "w")).select("doc_id", F.lit(0).alias("line_pos"), "text", F.lit(0.9).alias("confidence"))
    fields = lines.select("doc_id", F.lit(0).alias("field_pos"), F.lit("name").alias("field"), F.substring_index("text", " ", 2).alias("expected"))
    before = _written(spark)
    assert {r.status for r in M.verify(lines, fields).collect()} == {"match"}
    assert _written(spark) - before < 6000 * 4  # 40 documents of 1785 spans


def _written(spark):
    g = spark.sparkContext._gateway
    stages = spark._jsparkSession.sparkContext().statusStore().stageList(None, False, False, g.new_array(g.jvm.double, 0), g.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_older_matcher_prunes_only_what_cannot_reach(spark):
    from difflib import SequenceMatcher

    from attestra.operators import line_matcher

    texts = ["ann smith", "x" * 300, "a", "ann smith of the old mill lane by the river and more", "smith"]
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, line_pos int, text string")
    for want in ("ann smith", "smith of", "a n n"):
        fields = spark.createDataFrame([("d", 0, "address", want)], "doc_id string, field_pos int, field string, expected string")
        every = [*texts, *(f"{a} {b}" for a, b in zip(texts, texts[1:], strict=False))]
        best = max(SequenceMatcher(None, want.upper(), t.upper()).ratio() for t in every)
        got = line_matcher.verify(lines, fields).first()
        assert got.score == (pytest.approx(best, abs=1e-4) if best >= 0.35 else 0.0)


ODD = ["4a. 08.12.2017 Oslo", "a.\tb. 5.AB123", "x a.  c 7) d", "12. 5 é. ß ﬁ", "no--- -- _a_b A.B 8.FARG", "771204558910 ID-77 x9", "　a.　b c d", "2011-06-05 5/6/2011 050611 E", "a. -- ..", "Ünal und Söhne 3.", "same same same same", "x"]


def test_spans_compared_in_their_lines_are_those_compared_one_by_one(spark, monkeypatch):
    """Labels, odd blanks, all kinds of fields, several blocks and pieces of a line."""
    import random

    r = random.Random(3)
    lines = [(d, i, r.choice(ODD) + r.choice(["", " ", " . "]) + r.choice(ODD), r.choice([0.5, 0.9])) for d in "abc" for i in range(14)]
    words = [w for x in ODD for w in x.split()]
    names = ("name", "serial_number", "birth_date", "address", "remark")
    expected = [(d, i, names[i % 5], " ".join(r.choice(words) for _ in range(r.randint(1, 3)))) for d in "abcd" for i in range(15)]
    a, b = spark.createDataFrame(lines, "doc_id string, line_pos int, text string, confidence double"), spark.createDataFrame(expected, FIELD)
    fields, th = M.prepared(b), M.Thresholds()
    rows = lambda df: sorted((x.doc_id, x.field_pos, x.rank, x.text, x.found, x.score, str(x.resources)) for x in df.where("field_pos is not null").collect())
    want = rows(M.options(fields, M.candidates(a)))
    assert len(want) > 300 and {x[1] % 5 for x in want} == set(range(5))
    assert rows(M._all_options(a, fields, None, th, 4)) == want
    monkeypatch.setattr(M, "BLOCK", 60)
    monkeypatch.setattr(M, "SPANS", 7)
    assert rows(M._all_options(a, fields, None, th, 4)) == want


def test_work_compares_once_and_makes_no_rows_of_spans(spark, tmp_path):
    spark.createDataFrame([("d", 0, "LENA HOLM")], "doc_id string, line_pos int, text string").write.parquet(f"{tmp_path}/lines")
    plan = M.work(spark.read.parquet(f"{tmp_path}/lines"), spark.createDataFrame([("d", 0, "name", "LENA")], FIELD))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("find(") == 1 and "FlatMapGroupsInPandas" not in plan and plan.count("Relation [") <= 16


def test_matching_blocks_are_those_of_difflib():
    import random
    from difflib import SequenceMatcher

    from attestra.functions.similarity import covered

    r = random.Random(2)
    for n in range(4000):
        a, b = ("".join(r.choice("ABCDE"[: 2 + n % 4]) for _ in range(r.randint(0, m))) for m in (30, 230 if n % 50 == 0 else 40))
        assert covered(a, b) == sum(x.size for x in SequenceMatcher(None, a, b).get_matching_blocks())


def test_older_matcher_keeps_all_options(spark):
    """Thirteen fields that want the same fourteen lines: with twelve options each, the last would get none."""
    from attestra.operators import line_matcher

    lines = spark.createDataFrame([("d", i, "LENA" if i < 12 else "LENO", str(i)) for i in range(14)], "doc_id string, line_pos int, text string, source string")
    fields = spark.createDataFrame([("d", i, "name", "LENA") for i in range(14)], FIELD)
    got = [r.score for r in line_matcher.verify(lines, fields).orderBy("field_pos").collect()]
    assert sorted(got) == [0.75] * 2 + [1.0] * 12


def test_assignment_is_the_best_of_all():
    import random
    from functools import cache

    from attestra.functions.assignment import assigned

    def direct(fields):
        @cache
        def go(k, used):
            if k == len(fields):
                return 0.0, ()
            best, picked = go(k + 1, used)
            picked = (-1, *picked)
            for i, (s, xs) in enumerate(fields[k]):
                if not used & set(xs):
                    more, rest = go(k + 1, used | set(xs))
                    if s + more > best + 1e-9:
                        best, picked = s + more, (i, *rest)
            return best, picked

        return go(0, frozenset())

    r = random.Random(4)
    for _ in range(300):
        n, some = r.randint(1, 8), r.choice([(0.5, 1.0), (0.4, 0.6, 0.8, 1.0), None])
        places = [(i,) for i in range(n)] + [(i, i + 1) for i in range(n - 1)]
        fields = [sorted(((r.choice(some) if some else r.uniform(0.35, 1), x) for x in places if r.random() < 0.8), key=lambda o: -o[0]) for _ in range(r.randint(1, 6))]
        assert tuple(assigned(fields)) == direct(fields)[1]
    same = [[(1.0, (i,)) for i in range(40)] + [(0.8, (i, i + 1)) for i in range(39)]] * 120
    assert sum(x >= 0 for x in assigned(same)) == 40


def test_older_matcher_takes_each_ratio_once(spark, tmp_path):
    from attestra.operators import line_matcher

    spark.createDataFrame([("d", 0, "LENA HOLM")], "doc_id string, line_pos int, text string").write.parquet(f"{tmp_path}/lines")
    plan = line_matcher.verify(spark.read.parquet(f"{tmp_path}/lines"), spark.createDataFrame([("d", 0, "name", "LENA")], FIELD))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [ratio(") == 1 and "FlatMapGroupsInPandas" not in plan
