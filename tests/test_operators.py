import json
import math
import random

import pytest
from pyspark.sql import functions as F

from clearcharge import fixed_values as fv
from clearcharge import schemas
from clearcharge.functions import names, similarity
from clearcharge.operators import close_words, matching, places, positions, resolve, verdicts
from clearcharge.plans import prices
from clearcharge.streaming import admission
from tests.conftest import rows

LINE = ("k string, setting_expected string, code_type string, code string, other_codes array<string>, description string, setting string, billing_class string, modifiers string, "
        "gross decimal(18,6), discounted_cash decimal(18,6), minimum decimal(18,6), maximum decimal(18,6), source_ref string, off_template_note string, class_from_review boolean")


def line(k, want="outpatient", **kw):
    from decimal import Decimal

    base = dict(k=k, setting_expected=want, code_type="CPT", code="92557", other_codes=[], description="Hearing test", setting="outpatient", billing_class=None, modifiers=None,
                gross=None, discounted_cash=None, minimum=None, maximum=None, source_ref="row 1", off_template_note=None, class_from_review=False)
    base.update(kw)
    return {n: Decimal(str(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for n, v in base.items()}


def summarised(spark, *given):
    df = spark.createDataFrame([tuple(g[c.split(" ")[0]] for c in LINE.split(", ")) for g in given], LINE)
    return {r["k"]: r for r in verdicts.summarise(df, ["k"]).collect()}


def test_every_verdict(spark):
    f = dict(billing_class="facility")
    got = summarised(
        spark, line("clean", gross=2870, discounted_cash=1435, **f), line("class", gross=1, discounted_cash=2), line("setting", setting=None, gross=1, **f),
        line("mods", modifiers="RT", gross=1), line("mods", modifiers="52", gross=1), line("mods", minimum=3), line("negotiated", minimum=1), line("negotiated", minimum=2),
        line("conflict", discounted_cash=770, **f), line("conflict", discounted_cash=880, **f), line("inpatient", setting="inpatient", gross=6144, **f),
        line("both", setting="inpatient", gross=9, **f), line("both", gross=7, **f), line("doctor", billing_class="professional", gross=512),
        line("stay", want="inpatient", setting="outpatient", gross=5, **f), line("agree", gross=1910, discounted_cash=955, **f), line("agree", gross=1990, discounted_cash=955, source_ref="row 2", **f))
    verdict = {k: r["verdict"] for k, r in got.items()}
    assert verdict == {"clean": fv.COMPARABLE, "class": fv.UNKNOWN_CLASS, "setting": fv.UNKNOWN_SETTING, "mods": fv.MODIFIERS_ONLY, "negotiated": fv.NEGOTIATED_ONLY, "conflict": fv.CONFLICTING,
                       "inpatient": fv.INPATIENT_ONLY, "both": fv.COMPARABLE, "doctor": fv.PROFESSIONAL_ONLY, "stay": fv.OUTPATIENT_ONLY, "agree": fv.COMPARABLE}
    assert got["mods"]["detail"] == "priced lines carry modifiers 52, RT; no unmodified line to compare" and got["mods"]["headline"] is None
    assert got["negotiated"]["detail"].startswith("2 lines") and got["conflict"]["detail"] == "2 unmodified lines disagree (cash $770.00, $880.00)"
    assert "priced as inpatient" in got["stay"]["detail"] and got["both"]["headline"]["setting"] == "outpatient"
    assert got["agree"]["detail"].startswith("cash agrees; gross charges differ ($1,910.00, $1,990.00); 1 other line for this code")


def test_pages_and_verdicts_of_lines_read_them_once(spark, monkeypatch):
    from clearcharge.registry import reg_charges

    given = [line("a", source_ref=f"row {n}", gross=n, billing_class="facility") for n in range(1, 5)] + [line("b", source_ref="row 9", discounted_cash=3)]
    seen = spark.sparkContext.accumulator(0)

    def look(value):
        seen.add(1)
        return value

    df = spark.createDataFrame([tuple(g[c.split(" ")[0]] for c in LINE.split(", ")) for g in given], LINE)
    df = df.withColumnRenamed("k", "extraction_id").withColumn("service_id", F.lit("s")).withColumn("description", F.udf(look, "string")("description"))
    monkeypatch.setattr(reg_charges, "charge_lines", lambda *_: df)
    got = rows(reg_charges.merged_lines(spark, "none"), "extraction_id", "place", "ref", "line_count")
    assert got == [("a", 1, "row 1", 4), ("a", 2, "row 2", 4), ("a", 3, "row 3", 4), ("a", 4, "row 4", 4), ("b", 1, "row 9", 1)]
    assert seen.value == len(given)


def test_pairs_once_in_order_and_unpriced_named(spark):
    head = "struct<code_type:string,code:string,setting:string,billing_class:string,modifiers:string>"
    h = lambda s="outpatient", b="facility", m=None, t="CPT", c="1": (t, c, s, b, m)
    given = [("z", 1, "A", h()), ("z", 2, "B", None), ("z", 3, "C", h("both", t="HCPCS")), ("z", 4, "D", h(b=None)), ("z", 5, "E", h("inpatient", "professional", "26", c="2"))]
    df = spark.createDataFrame([(k, r, n, n, x) for k, r, n, x in given], f"k string, rank int, ccn string, name string, headline {head}")
    got = verdicts.priced_pairs(df, ["k"]).first()
    assert got["unpriced"] == ["B"] and [(p["a"], p["b"]) for p in got["pairs"]] == [("A", "C"), ("A", "D"), ("A", "E"), ("C", "D"), ("C", "E"), ("D", "E")]
    said = {(p["a"], p["b"]): (p["verdict"], p["detail"]) for p in got["pairs"]}
    assert said["A", "C"] == ("comparable", "outpatient, facility, no modifiers") and said["A", "D"] == ("unknown", "D's row has no billing class")
    assert said["A", "E"] == ("not comparable", "different codes (CPT 1 vs CPT 2); outpatient vs inpatient; facility vs professional charge; modifiers none vs 26")


def _km(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * fv.EARTH_RADIUS_KM * math.asin(math.sqrt(h))


def test_nearest_equals_brute_force_with_crowds_copies_and_the_date_line(spark):
    rng = random.Random(5)
    points = [(rng.uniform(-80, 80), rng.uniform(-180, 180)) for _ in range(150)] + [(44.3 + rng.random() / 50, 7.1 + rng.random() / 50) for _ in range(400)] + [(40.0, -100.0)] * 250
    hospitals = spark.createDataFrame(
        [(f"{i:04d}", f"n{i % 7}", "a", "c", "s", "z", "t", "o", la, lo, "zip" if i % 3 else "address", None, 1.0, None) for i, (la, lo) in enumerate(points)], schemas.HOSPITALS)
    origins = [("a", 44.31, 7.11), ("b", 40.0, -100.0), ("c", 10.0, 179.9), ("d", -60.0, -179.5), ("e", 0.0, 0.0)]
    zcta = spark.createDataFrame([(z, la, lo, 1.0) for z, la, lo in origins], schemas.ZCTA)
    got = rows(places.nearest_hospitals(hospitals, zcta, zcta.select("zip"), 6), "query_zip", "rank", "ccn")
    expected = []
    for z, la, lo in origins:
        order = sorted((_km((la, lo), p), "zip" if i % 3 else "address", f"n{i % 7}", f"{i:04d}") for i, p in enumerate(points))
        expected += [(z, r + 1, o[3]) for r, o in enumerate(order[:6])]
    assert got == sorted(expected)
    with pytest.raises(ValueError):
        places.nearest_hospitals(hospitals, zcta, zcta, 0)


def test_nearest_shuffles_cells_of_origins_and_not_origins(spark, monkeypatch):
    rng = random.Random(8)
    points = [(rng.uniform(30, 40), rng.uniform(-100, -90)) for _ in range(60)]
    hospitals = spark.createDataFrame([(f"{i:04d}", f"n{i % 7}", "a", "c", "s", "z", "t", "o", la, lo, "address", None, 1.0, None) for i, (la, lo) in enumerate(points)], schemas.HOSPITALS)
    origins = [(f"{i:05d}", 35 + rng.random() / 10, -95 + rng.random() / 10) for i in range(1500)]
    zcta = spark.createDataFrame([(z, la, lo, 1.0) for z, la, lo in origins], schemas.ZCTA).cache()
    looked_at, keep = [], places._keep_reachable

    def counted(cells, *rest):
        looked_at.append(cells.count())
        return keep(cells, *rest)

    monkeypatch.setattr(places, "_keep_reachable", counted)
    monkeypatch.setattr(places, "_LIST", 4, raising=False)  # lists in several rows
    got = rows(places.nearest_hospitals(hospitals, zcta, zcta.select("zip"), 3), "query_zip", "rank", "ccn")
    expected = []
    for z, la, lo in origins:
        expected += [(z, r + 1, o[1]) for r, o in enumerate(sorted((_km((la, lo), p), f"{i:04d}") for i, p in enumerate(points))[:3])]
    assert got == sorted(expected) and max(looked_at) < len(origins)


def _ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j], row[j + 1])
    return 200 * row[-1] / (len(a) + len(b))


def test_close_words_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    known = {word(rng.randint(3, 14)) for _ in range(120)} | {word(n) for n in (47, 48, 49, 50, 60, 90)}

    def typo(w):
        w = list(w)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(w))
            w[i:i + 1] = rng.choice([[], [rng.choice("abcd")], [w[i], rng.choice("abcd")]])
            w = w or ["a"]
        return "".join(w)

    unknown = {typo(w) for w in known}
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    got = {(r["word"], r["known"]) for r in close_words.close_pairs(frame(unknown), frame(known), 87).collect()}
    assert got == {(u, k) for u in unknown for k in known if _ratio(u, k) >= 87}


def test_ratio_and_short_words(spark):
    df = spark.createDataFrame([("colonscopy", "colonoscopy"), ("lewenstein", "levenshtein")], "a string, b string")
    assert [round(r[0], 3) for r in df.select(similarity.indel_ratio(F.col("a"), F.col("b"))).collect()] == [95.238, 85.714]


SERVICES = [
    (0, "cpt-73721", "", "MRI scan of leg joint", [("CPT", "73721")], ["knee mri"], {"contrast": "without"}, False, ""), (1, "cpt-45378", "", "Diagnostic examination of large bowel", [("CPT", "45378")], ["colonoscopy"], {"biopsy": "without"}, False, ""),
    (2, "cpt-45380", "", "Biopsy of large bowel", [("CPT", "45380")], ["colonoscopy with biopsy"], {"biopsy": "with"}, False, ""), (3, "cpt-72110", "", "X-ray, lower back", [("CPT", "72110")], ["lumbar x-ray"], {}, False, ""),
    (4, "cpt-70553", "", "MRI scan of brain", [("CPT", "70553")], ["brain mri"], {"contrast": "with and without"}, False, "")]


def test_resolution(spark):
    asked = {"knee mri": (fv.SELECTED, "cpt-73721"), "45378": (fv.SELECTED, "cpt-45378"), "colonoscopy with biopsy": (fv.SELECTED, "cpt-45380"), "colonoscopy without biopsy": (fv.SELECTED, "cpt-45378"),
             "colonoscopy": (fv.SELECTED, "cpt-45378"), "knee mri with contrast": (fv.UNSUPPORTED_VARIANT, None), "knee mri with biopsy": (fv.NEEDS_CLARIFICATION, None),
             "knee mri with contrast without contrast": (fv.NEEDS_CLARIFICATION, None), "mri": (fv.AMBIGUOUS, None), "chest x-ray": (fv.NOT_IN_CATALOG, None), "lumbar xray": (fv.SELECTED, "cpt-72110"),
             "xyzzy": (fv.NOT_IN_CATALOG, None), "colonscopy": (fv.SELECTED, "cpt-45378"), "cbd": (fv.NOT_IN_CATALOG, None), "of the": (fv.NOT_IN_CATALOG, None)}
    got = {r["query"]: r for r in resolve.resolve(spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame(SERVICES, schemas.SERVICES)).collect()}
    assert {q: (r["verdict"], r["service_id"]) for q, r in got.items()} == asked
    assert "with contrast is not on it" in got["knee mri with contrast"]["reason"] and "both with and without contrast" in got["knee mri with contrast without contrast"]["reason"]
    assert got["colonscopy"]["corrections"] == [("colonscopy", "colonoscopy")] and got["chest x-ray"]["reason"].startswith("nothing in the catalog matches chest; closest is X-ray")


def test_matching_and_ties(spark):
    e = lambda i, n, name, url=None: (i, n, name, url)
    entries = spark.createDataFrame([
        e("hh", 1, "Linden Valley Oakmere Hospital"), e("hh", 2, "Linden Valley Petrel Bay Hospital"), e("el", 1, "88 Lantern Holdings, LLC d/b/a Summit Hospital Fernside"),
        e("as", 1, "Corvane Abbey Upland (Corvane Abbey)", "https://x.org/120045518-1506318272_a_standardcharges.csv"), e("as", 2, "Corvane Abbey Lowland (Corvane Abbey)", "https://x.org/120045518-1927483069_a_standardcharges.csv"),
        e("as", 3, "Abbey ER 24/7")], "index_id string, entry_no bigint, location_name string, mrf_url string")
    hospitals = spark.createDataFrame([
        ("1", "LINDEN VALLEY", "hh", "a", "DUNMERE", "40988"), ("2", "FERNSIDE PINES HOSPITAL", "hh", "a", "DUNMERE", "40988"), ("3", "SUMMIT HOSPITAL FERNSIDE", "el", "a", "b", "c"),
        ("4", "CORVANE ABBEY UPLAND", "as", "a", "b", "c"), ("5", "CORVANE ABBEY", "as", "640 QUAYSIDE BOULEVARD", "MARLOW", "40871")], "ccn string, name string, index_id string, address string, city string, zip string")
    out = matching.match_entries(hospitals, entries)
    got = {r["ccn"]: r for r in out.collect()}
    assert [got[c]["verdict"] for c in "12345"] == ["ambiguous", "none", "matched", "matched", "ambiguous"]
    assert got["3"]["score"] == 100 and got["4"]["entry_no"] == 1 and len(got["1"]["candidates"]) == 2
    registry = spark.createDataFrame([("1506318272", "640 QUAYSIDE", "Marlow", "40871"), ("1927483069", "17 GRANITE ROW", "MARLOW", "40872")], "npi string, address string, city string, zip string")
    tie = {r["ccn"]: r for r in matching.npi_tie_break(out.filter("verdict = 'ambiguous'"), registry).collect()}
    assert tie["5"]["entry_no"] == 1 and "640 QUAYSIDE, Marlow" in tie["5"]["why"] and tie["1"]["why"] == "no NPI in the filenames"


def test_frequent_words_do_not_compare_half_the_index(spark, monkeypatch):
    """One word in 49 of 100 names: the same rows as comparing all that share it, from few pairs."""
    rng = random.Random(12)
    syllables = ["ba", "ke", "lo", "mi", "nu", "ra", "se", "ti", "vo", "wu", "xa", "zy"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))).upper()
    listed = [("ix", i, ("LANTERN " if i % 100 < 49 else "") + " ".join(word() for _ in range(rng.randint(1, 3))), f"u{i}") for i in range(1_000)]
    listed += [("ix", 1_000 + i, listed[i * 7][2], f"v{i}") for i in range(5)] + [("other", 1, "LANTERN HILL", "w")]

    def changed(name):
        letters = list(name)
        for _ in range(rng.choice([0, 0, 0, 1])):
            letters[-rng.randrange(1, 4)] = rng.choice("AEIOU")
        return "".join(letters)

    asked = [(str(i), changed(listed[rng.randrange(1_000)][2]), "ix") for i in range(150)] + [("n", "LANTERN QQQQQQQQQ JJJJJJJJJJJ", "ix"), ("o", "LANTERN", "ix"), ("p", "LANTERN HILL", "other")]
    entries = spark.createDataFrame(listed, "index_id string, entry_no bigint, location_name string, mrf_url string")
    hospitals = spark.createDataFrame(asked, "ccn string, name string, index_id string")
    pairs = []
    kept = matching.compared
    monkeypatch.setattr(matching, "compared", lambda *given: pairs.append(kept(*given)) or pairs[-1])
    said = {}
    for selective in (10**9, 20):
        monkeypatch.setattr(matching, "SELECTIVE", selective)
        said[selective] = sorted(map(str, matching.match_entries(hospitals, entries).collect()))
    assert said[20] == said[10**9]
    plain, few = (p.count() for p in pairs)
    assert plain > 25_000 and few < plain / 5, (plain, few)


def test_a_word_in_most_entries_keeps_the_best_of_each_name_only(spark, monkeypatch):
    """Alike names that share frequent words: the same rows as comparing all of them, from five pairs a word and block."""
    rng = random.Random(5)
    place, kind = ["NORTHEAST", "KINGWOOD", "SUGAR LAND"], ["GENERAL", "CHILDRENS", "MEMORIAL"]
    listed = [("ix", i, f"LANTERN {rng.choice(place)} {rng.choice(kind)} {rng.randrange(40)}" + (" d/b/a " + "Q" * 70 + f" {rng.choice(kind)}" if i % 50 == 0 else ""), f"u{i}") for i in range(400)]
    asked = [(str(i), f"LANTERN {rng.choice(place)} {rng.choice(kind)} {rng.randrange(60)}", "ix") for i in range(80)] + [("a", "LANTERN", "ix"), ("b", None, "ix"), ("c", "", "ix"), ("d", "GENERAL", None)]
    entries = spark.createDataFrame(listed + [("ix", None, "LANTERN GENERAL 1", "v"), (None, 1, "GENERAL", "w"), ("ix", 7, None, "x")], "index_id string, entry_no bigint, location_name string, mrf_url string")
    hospitals = spark.createDataFrame(asked, "ccn string, name string, index_id string")
    pairs, kept = [], matching.compared
    monkeypatch.setattr(matching, "compared", lambda *given: pairs.append(kept(*given)) or pairs[-1])
    said = {}
    for selective, block in ((10**9, 4096), (20, 4096), (20, 60)):
        monkeypatch.setattr(matching, "SELECTIVE", selective)
        monkeypatch.setattr(matching, "_BLOCK_ENTRIES", block, raising=False)
        monkeypatch.setattr(matching, "_BLOCK_TARGETS", block // 2, raising=False)
        said[selective, block] = sorted(map(str, matching.match_entries(hospitals, entries).collect()))
    assert said[20, 4096] == said[10**9, 4096] == said[20, 60]
    assert pairs[1].groupBy("target").count().agg(F.max("count")).first()[0] < 60  # 20 entries hold a number, 5 for each frequent word


def test_ratios_of_many_texts_equal_those_of_pairs():
    rng = random.Random(3)
    draw = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    for letters in ("ab", "abcdefgh xyz", "aéß😀 "):
        texts = [draw(rng.choice([0, 3, 40, 64, 65, 200]), letters) for _ in range(40)]
        for text in [draw(n, letters + "q") for n in (0, 1, 63, 64, 65, 128, 129, 200)]:
            expected = [100.0 if not text and not t else 200.0 * similarity._lcs(text, t) / (len(text) + len(t)) for t in texts]
            assert similarity.Texts(texts).ratios(text).tolist() == expected


def _admission_model(attempts, limit, window=3600):
    expected = []
    for ip in {a[0] for a in attempts}:
        recent = []
        for _, i, s in sorted((a for a in attempts if a[0] == ip), key=lambda a: (a[2], a[1])):
            recent = [t for t in recent if s - t < window]
            if len(recent) < limit:
                recent.append(s)
                expected.append((i, True, 0))
            else:
                expected.append((i, False, window - (s - recent[0])))
    return sorted(expected)


@pytest.mark.parametrize("limit, part_rows", [(1, 40), (3, 40), (3, 10_000), (7, 25)])
def test_admission_equals_a_plain_model(spark, limit, part_rows):
    """One address with nearly all attempts covers many parts; quiet and busy stretches, and attempts at one moment."""
    rng = random.Random(limit)
    attempts = [(f"ip{0 if i % 20 else rng.randrange(3)}", i, rng.choice([rng.randrange(60_000), rng.randrange(20) * 3_000, rng.randrange(300_000)])) for i in range(500)]
    df = spark.createDataFrame(attempts, "address string, attempt_id bigint, s bigint").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = rows(admission.admission_batch(df, limit, part_rows=part_rows), "attempt_id", "admitted", "wait_seconds")
    assert got == _admission_model(attempts, limit)


def test_admission_of_no_attempts_and_of_one_at_its_limit_without_end(spark):
    schema = "address string, attempt_id bigint, s bigint"
    steady = [("a", i, i * 7) for i in range(2_000)]
    frame = lambda given: spark.createDataFrame(given, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    assert rows(admission.admission_batch(frame(steady), 2, part_rows=300), "attempt_id", "admitted", "wait_seconds") == _admission_model(steady, 2)
    assert admission.admission_batch(frame([]), 2).count() == 0


@pytest.mark.parametrize("part_rows", [7, 10_000])
def test_positions_and_running_sums_of_a_hot_group(spark, part_rows):
    rng = random.Random(1)
    given = [(None if i % 9 == 0 else "hot" if i % 9 < 7 else f"k{i % 5}", rng.choice([None, rng.randrange(30)]), i, rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(given, "k string, at int, id int, v int").repartition(5)
    got = {r["id"]: (r["nth"], r["before"]) for r in positions.numbered(df, ["k"], [F.col("at"), F.col("id")], "nth", part_rows, "v", "before").collect()}
    sums = {r["id"]: r["b"] for r in positions.summed_before(df, ["k"], [F.col("at"), F.col("id")], "v", "b", part_rows).collect()}
    for k in {g[0] for g in given}:
        total = 0
        for n, (_, _, i, v) in enumerate(sorted((g for g in given if g[0] == k), key=lambda g: (g[1] is not None, g[1] or 0, g[2])), 1):
            assert got[i] == (n, total) and sums[i] == total
            total += v
    whole = [r["id"] for r in positions.numbered(df, [], [F.col("id").desc()], "nth", part_rows).orderBy("nth").collect()]
    assert whole == list(range(299, -1, -1)) and positions.numbered(df.limit(0), ["k"], [F.col("id")], "nth").count() == 0


def test_best_external_equals_brute_force(spark):
    rng = random.Random(6)
    parts = ["NORTH", "SOUTH", "MERCY", "SAINT", "OAK", "VALLEY", "GENERAL", "LAKE", "HILL", "COUNTY"]
    name = lambda: " ".join(rng.choice(parts) + rng.choice(["", "", "E", "S"]) for _ in range(rng.randint(1, 5)))
    ours, theirs = [(str(i), name()) for i in range(60)], [(i, name(), f"u{i}") for i in range(80)]
    got = {r["ccn"]: (round(r["score"], 6), r["row_no"]) for r in matching.best_external(spark.createDataFrame(ours, "ccn string, name string"), spark.createDataFrame(theirs, "row_no bigint, name string, url string")).collect()}
    words = {n: r for n, r in spark.createDataFrame([(n,) for n in {n for _, n in ours} | {n for _, n, _ in theirs}], "n string").select("n", similarity.sorted_words(names.match_text(F.col("n")))).collect()}
    want = {}
    for ccn, n in ours:
        scored = [(-_ratio(words[n], words[t]), i) for i, t, _ in theirs if words[n] and words[t] and _ratio(words[n], words[t]) >= fv.EXTERNAL_INDEX_SCORE]
        if scored:
            want[ccn] = (round(-min(scored)[0], 6), min(scored)[1])
    assert got == want and 10 < len(want) < 60


def test_pages_hold_every_line_once_in_order(spark):
    given = spark.range(3_000).select(
        F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("k"), F.lit("CPT").alias("code_type"), F.concat(F.lit("9"), (F.col("id") % 3).cast("string")).alias("code"), F.array().cast("array<string>").alias("other_codes"),
        F.lit("Hearing test é").alias("description"), *[F.lit(None).cast("string").alias(c) for c in ("setting", "billing_class", "modifiers")], *[F.col("id").cast("decimal(18,6)").alias(c) for c in ("gross", "discounted_cash", "minimum", "maximum")],
        F.concat(F.lit("row "), F.col("id").cast("string")).alias("source_ref"), F.lit(None).cast("string").alias("off_template_note"), F.lit(False).alias("class_from_review"))
    pages = prices.line_pages(given, ["k"], page_bytes=5_000, part_rows=400).orderBy("k", "page").collect()
    for k in "ab":
        mine = [p for p in pages if p["k"] == k]
        lines_of = [json.loads(p["lines"]) for p in mine]
        refs = [x["ref"] for page in lines_of for x in page]
        want = sorted((i for i in range(3_000) if (i % 10 == 0) == (k == "b")), key=lambda i: (i % 3, f"row {i}"))
        assert refs == [f"row {i}" for i in want] and [p["page"] for p in mine] == list(range(len(mine)))
        assert [p["first"] for p in mine] == [1 + sum(map(len, lines_of[:n])) for n in range(len(mine))]
        assert max(len(p["lines"].encode()) for p in mine) < 6_000
