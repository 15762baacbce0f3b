import random
import re
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.llm import bpe, canon, cutoff, langid, leaks, neardup, pages, pii, residue, unify


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- 1 ----------------------------------------------------------------------------------------------------------------

FIRST = "Arel Bovin Corina Delmar Edwyn Farlo Gretha Hollis Ivana Jorin".split()
LAST = "Quillmere Sandholt Tarnbeck Umberlow Vostrand Wexley".split()


def cv(i):
    r = random.Random(i)
    name, other = f"{r.choice(FIRST)} {r.choice(LAST)}", f"{r.choice(FIRST)} {r.choice(LAST)}"
    return (
        f"{name}\nTel. +44 7700 900{i % 900 + 100}\nE-mail: {name.split()[0].lower()}.x{i}@post.example\nAddress: {i % 90 + 1} Elm Lane, Norford, QX{i % 9} 4ZX\nPassport 00{i % 8 + 1}-44-{1000 + i}\n\n"
        f"Reported to {other}, head of stores.\nShipped order 0{i % 90 + 10} 119 4{i % 90 + 10} under norm ZN 2-265-2 on 14.03.2012 to Acme Works."
    )


@pytest.fixture(scope="module")
def model():
    return pii.fit([cv(i) for i in range(300)])


def test_pii_of_known_forms(model):
    t = cv(777)
    got = {(k, t[a:b]) for k, a, b, _ in pii.spans(model, [t])[0]}
    assert {k for k, _ in got} == set(pii.LABELS[1:])
    assert ("address", "58 Elm Lane, Norford, QX3 4ZX") in got and ("email", re.search(r"\S+@\S+", t)[0]) in got
    assert not any("119" in v or "ZN" in v or "14.03" in v or "Acme" in v for _, v in got)
    assert sum(k == "name" for k, _ in got) == 2


def test_pii_spans_fit_odd_characters(model):
    t = "​" + cv(5).replace("Tel.", "T​el.").replace("900", "９００")
    for k, a, b, _ in pii.spans(model, [t])[0]:
        assert 0 <= a < b <= len(t) and t[a:b].strip() == t[a:b]
    assert "phone" in {k for k, *_ in pii.spans(model, [t])[0]}


def test_pii_beyond_any_window(model):
    long_mail = "a." + "b" * 150 + "@" + "sub." * 40 + "example"
    far = "Flat 12,\nQuayside House,\n7 Elm " + "Longstreetname" * 12 + " Lane,\nNorford, QX3 4ZX"
    t = f"{cv(3)}\nWrite to {long_mail} today.\nAddress: {far}\n"
    got = {(k, t[a:b]) for k, a, b, _ in pii.spans(model, [t])[0]}
    assert ("email", long_mail) in got and ("address", far) in got


def test_pii_surname_that_is_a_frequent_phrase_end(model):
    name = re.match(r".*", cv(777))[0]
    t = cv(777).replace(name, "Gretha Works").replace("Reported to ", "Reported to Gretha Works, head of yards.\nReported to ")
    got = [t[a:b] for k, a, b, _ in pii.spans(model, [t])[0] if k == "name"]
    assert "Gretha Works" in got and "Acme Works" not in got


def test_pii_frames(spark, model):
    d = spark.createDataFrame([(1, cv(1), "x"), (1, cv(1), "x"), (2, None, "x"), (3, "", "x"), (None, "Call a.b@c.example", "x")], "id int, t string, pii_type string")
    got = pii.found_spans(d, "id", "t", model)
    assert {r.id for r in got.collect()} == {1, None} and got.where("id = 1").count() % 2 == 0
    m = {r.id: r.t for r in pii.masked(d, "id", "t", model).collect()}
    assert m[None] == "Call [EMAIL]" and m[2] is None and m[3] == "" and "[PHONE]" in m[1] and "7700" not in m[1]
    assert pii.found_spans(d.limit(0), "id", "t").count() == 0


def test_pii_names_and_numbers_by_first_letter():
    s = "  Moss, Ada\nMoss, Ada, B. Cole-Hart\nJo Ann Pike-, x Ida van der Loo.A\nLee, J. P.\r\nd'Or Kim-'Li"
    names = [s[a:b] for a, b in pii._names(s, [0] + [m.end() for m in re.finditer("\n", s)])]
    assert names == ["  Moss, Ada", "Moss, Ada", "B. Cole-Hart", "Jo Ann Pike", "Lee, J. P."]
    numbers = "a+44 20 7946 0000 x12, (020) 1234-567; AB-12345C QQ 12 34 56 C x1234567 .12345 @98765 +(0)123 45"
    assert [m[0] for m in pii.NUMBER.finditer(numbers)] == ["20 7946 0000 x12", "(020) 1234-567", "AB-12345C", "QQ 12 34 56 C", "+(0)123 45"]


def test_pii_long_words_take_no_square_time():
    long = "a" * 60_000
    start = time.process_time()
    assert pii.straight(f"ж {long}") == (f"ж {long}", None)
    assert time.process_time() - start < 2


# --- 2 ----------------------------------------------------------------------------------------------------------------


def test_consistent_form(spark):
    lines = ["ｆｕｌｌ １２", "café", "ạ́", "ạ́", "zero​width", "no\xa0break", "Sаlе", "Привет мир", "m² ½ 3º №5 x™ “q” – •", "oﬃce", "non‑break", "𝐁𝐨𝐥𝐝", "​", "fine\r", "рrоса"]
    want = ["full 12", "café", "ạ́", "ạ́", "zerowidth", "no break", "Sale", None, None, "office", "non-break", "Bold", "", None, "proca"]
    d = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, ""), (1, "\n".join(lines))], "id int, t string")
    got = {r.line_no: r.form for r in unify.consistent_lines(d, "id", "t").collect()}
    assert got == {i: unicodedata.normalize("NFC", w) for i, w in enumerate(want) if w is not None}
    again = unify.consistent_text(d.withColumn("form", F.lit(0)), "id", "t")
    assert again.count() == 4 and unify.consistent_lines(again, "id", "t").count() == 0


def test_marks_equal_unicode(spark):
    random.seed(1)
    texts = ["".join(random.choice("aeounAsẓ̧́̀̈é") for _ in range(12)) + "x" for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.form for r in unify.consistent_lines(d, "id", "t").collect()}
    assert all(got.get(i, t) == unicodedata.normalize("NFC", t) for i, t in enumerate(texts))


def test_starters_that_compose_equal_unicode(spark):
    texts = ["한국어 문장", "값 넋 여덟", "\u1100\u1161\u11a8\u11a8", "\u09c7\u09be \u0bc6\u0bbe \u0dd9\u0dcf", "\u09be\u09be", "\u1100\u0301\u1161", "나는 간다"]
    texts = [unicodedata.normalize("NFD", t) for t in texts]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.form for r in unify.consistent_lines(d, "id", "t").collect()}
    assert [got.get(i, t) for i, t in enumerate(texts)] == [unicodedata.normalize("NFC", t) for t in texts] and len(got) >= 5


# --- 3 ----------------------------------------------------------------------------------------------------------------

GOOD = ["You will look after stock counts and report to the site lead.", "Our team shares one office and takes turns with the late shift.", "A typical day starts with sample logs and ends with a handover.", "We rely on careful notes for the archive, though training is given.", "Forms marked [INSERT DATE HERE] are still printed and we want to replace them."]


def jobs_frame(spark):
    r = random.Random(2)
    data = [(f"g{i}", " ".join(r.sample(GOOD, 3)) + f" Step {i}.", f"Clerk {'ABCD'[i % 4]}", f"https://h{i % 12}.test/{i}") for i in range(120)]
    data += [(f"p{i}", r.choice(GOOD[:4]) + f"\nThe place of work is {p}.", "Clerk", f"https://h{i % 12}.test/{i}") for i, p in enumerate(["{{city}}", "@@town@@", "${place}", "[[site]]", "<%= x %>", "__CITY__"] * 4)]
    data += [(f"e{i}", f"Error {400 + i % 5}\nThe server did not answer within {i} s.\nAccess denied.", "Clerk", f"https://h{i % 12}.test/{i}") for i in range(20)]
    data += [(f"f{i}", r.choice(GOOD[:4]) + "\nLorem ipsum dolor sitar ametur vorem.", "Untitled document", None) for i in range(20)]
    data += [("null", None, None, None), ("empty", "", "", "")]
    return spark.createDataFrame(data, "id string, raw_text string, title string, source_url string")


def test_residue(spark):
    d = jobs_frame(spark)
    got = {(r.id, r.field_name) for r in residue.unfit_fields(d).collect()}
    want = {(i, "raw_text") for i in [f"p{k}" for k in range(24)] + [f"e{k}" for k in range(20)] + [f"f{k}" for k in range(20)]} | {(f"f{k}", "title") for k in range(20)}
    assert got == want
    confusion = residue.validation(d).collect()
    right = sum(r.units for r in confusion if r.weak == r.kind)
    assert right / sum(r.units for r in confusion) > 0.95
    assert residue.unfit_fields(d.limit(0)).count() == 0


def test_residue_signs_that_many_units_of_others_crowd_out(spark):
    r = random.Random(4)
    syllables = "lac men ren pos vir dol qui tad".split()
    word = lambda: "".join(r.choices(syllables, k=3)) + "it"
    filler = spark.createDataFrame([(f"l{i}", " ".join(word() for _ in range(9)) + ".", "Clerk", f"https://h{i % 12}.test/l{i}") for i in range(9_000)], "id string, raw_text string, title string, source_url string")
    phrases = ["tbd tbd tbd", "Your text here", "xxxxxxxx xxxx", "(placeholder) (placeholder)", "Dummy paragraph, to be replaced.", "- bullet one", "- bullet two", "foo bar baz foo bar", "Qwertz qwertz."]
    rare = spark.createDataFrame([(f"r{i}", p, "Clerk", None) for i, p in enumerate(phrases)], filler.schema)
    got = {r.id for r in residue.unfit_fields(jobs_frame(spark).unionAll(filler).unionAll(rare)).collect()}
    assert {f"r{i}" for i in range(len(phrases))} <= got and not {f"g{i}" for i in range(120)} & got


def test_residue_of_other_forms(spark):
    texts = ["Salary: XX-TBC-XX", "The day starts at xx.xx on the dot.", "We meet in {place} on Mondays.", "Sample text. Sample text. Sample text.", "TODO: write the advert", "404 Not Found\nThe page you asked for could not be found.\nGo to the front page."]
    good = ["Ofrecemos de todo: té, pan y fruta.", "You fix what visitors see on our “page not found” screen.", "Popular searches: Payroll Officer, Payroll Officer, Payroll Officer\nYou look after the notes of the archive."]
    data = [(f"x{i}", t, "Clerk", None) for i, t in enumerate(texts)] + [(f"y{i}", t, "Clerk", None) for i, t in enumerate(good)] + [("t", GOOD[0], "HTTP 503", None)]
    d = jobs_frame(spark)
    got = {(r.id, r.field_name) for r in residue.unfit_fields(d.unionAll(spark.createDataFrame(data, d.schema))).collect()}
    assert {x for x in got if x[0][0] in "xyt"} == {(f"x{i}", "raw_text") for i in range(len(texts))} | {("t", "title")}


def test_residue_menus_of_a_few_error_pages_are_content(spark):
    menu = "Home | Jobs | Help for you"
    data = [(f"m{i}", f"{menu}\n{GOOD[i % 4]}", "Clerk", None) for i in range(60)] + [(f"e{i}", f"{menu}\nError 404\nAccess denied", "Clerk", None) for i in range(3)]
    d = spark.createDataFrame(data, "id string, raw_text string, title string, source_url string")
    assert [x.weak for x in residue.distinct_units(residue.units(d, "id", "raw_text", "title", "source_url")).where(F.col("unit") == menu).collect()] == [0]


# --- 4 ----------------------------------------------------------------------------------------------------------------


def test_pages(spark):
    r = random.Random(3)
    body = lambda i: ["Tasks", f"You sort parcels by size {i}.", "Offer", "* Free tea", "* Bicycle lease"]
    data = [(f"b{i}", "\n".join(body(i)), None, f"Job {i}") for i in range(40)]
    for i in range(60):
        menu = " | ".join(r.sample(["Home", "Jobs", "Help", "Legal", "Press"], 3))
        data.append((f"s{i}", "\n".join([menu, f"Job {i}", *body(i), "", "Share this page", f"© 20{10 + i % 10} site{i % 5}"]), f"https://www.site{i % 5}.test/x", f"Job {i}"))
    data += [("once", "\n".join(["Home | Press", "Job", *body(1), "Share this page"]), "https://single.test", "Job"), ("err", "Error 404\nNot found", "https://www.site1.test/e", None), ("none", None, "https://x.test", None)]
    d = spark.createDataFrame(data, "id string, raw_text string, source_url string, title string")
    got = {(x.id, x.line_no) for x in pages.judged_lines(d).where("not main").collect()}
    want = {(f"s{i}", n) for i in range(60) for n in (0, 8, 9)} | {("once", 0), ("once", 7)}
    assert got == want
    assert {x.id: x.main_text for x in pages.main_text(d).collect()}["once"] == "\n".join(["Job", *body(1)])
    assert pages.judged_lines(d.limit(0)).count() == 0


def test_pages_chance_repeats_and_copies_are_no_template(spark):
    text = lambda i, extra: "\n".join(["Tasks", f"You sort parcels by size {i}.", "Offer", *extra])
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    data = [(f"b{i}", text(i, []), None, f"Job {i}") for i in range(80)]
    # a site of 200 pages: a menu on all, French words on twelve, a requirement that three postings happen to share
    for i in range(200):
        extra = ["* Lathe keeping is a must"] if i in (20, 90, 150) else []
        data.append((f"h{i}", "\n".join([f"Job {i}", text(i, extra), f"Offer code {letters(i)}", "Partager la page" if i % 17 == 0 else "Share this page"]), "https://hot.test/x", f"Job {i}"))
    # a small site that shows one posting four times
    data += [(f"c{i}", "\n".join(["Job", text(i, ["* Kiln watch by night"]), "Seen 1" + "0" * i]), "https://small.test/x", "Job") for i in range(4)]
    d = spark.createDataFrame(data, "id string, raw_text string, source_url string, title string")
    got = {(x.id, x.line_no): x.main for x in pages.judged_lines(d).collect()}
    assert all(got[f"h{i}", 4] for i in (20, 90, 150)) and all(got[f"c{i}", 4] for i in range(4))
    assert not any(got[f"h{i}", 6 if i in (20, 90, 150) else 5] for i in range(200))


# --- 5 ----------------------------------------------------------------------------------------------------------------

REFERENCE = [("kiln-control", "Kiln firing control", ["furnace curve setting"]), ("korvane", "Korvane", ["kvn"]), ("korvane-reports", "Korvane Reports", []), ("loom", "Loom calibration", [])]


def test_mapping(spark):
    ref = spark.createDataFrame(REFERENCE, "id string, label string, aliases array<string>")
    typed = {
        "KILN FIRING CONTROL": "kiln-control", "kiln firng contrlo": "kiln-control", "control, kiln firing": "kiln-control", "experience with Körvane": "korvane", "KVN": "korvane", "kvm": "unmatched",
        "korvane reprots v3": "korvane-reports", "kor vane": "korvane", "control firing kiln": "kiln-control", "firnig control kiln": "kiln-control", "chess doubling": "unmatched", "": "unmatched", None: "unmatched", "with": "unmatched", "loomcalibration (advanced)": "loom",
    }
    d = spark.createDataFrame([(i, k, "c") for i, k in enumerate(typed)] + [(99, "kvn", "c")] * 2, "n int, label string, aliases string")
    got = canon.mapped(d, "label", ref)
    assert {r.label: r.mapped_id for r in got.collect()} == typed | {"kvn": "korvane"} and got.count() == len(typed) + 2
    joined = canon.mapped(d, "label", ref, broadcast_surfaces=2)
    assert {(r.label, r.mapped_id, r.mapped_distance) for r in joined.collect()} == {(r.label, r.mapped_id, r.mapped_distance) for r in got.collect()} and joined.count() == got.count()
    assert {r.typed for r in canon.misses(got, "label").collect()} >= {"kvm", "chess doubling"}
    assert canon.mapped(d, "label", ref.limit(0)).where("mapped_id <> 'unmatched'").count() == 0


def test_dictionary_reaches_all_within_radius():
    random.seed(5)
    d = canon.Dictionary([(w, w, 0) for w in ("harbourpilot", "grainsampling", "brailleproof")])
    for _ in range(300):
        w = random.choice(list(d.entries))
        t = list(w)
        for _ in range(random.randint(1, 2)):
            i = random.randrange(1, len(t))
            t[i : i + 1] = random.choice([[], [random.choice("xyz")], [t[i], random.choice("xyz")]])
        t = "".join(t)
        if canon.near(t, w) <= canon.radius(len(w)):
            assert d.find(t)[0] == w


def test_weighted_and_plain_distance_bound_alike():
    assert canon.distance("aabbccdd", "abcd", 3) <= 3 and canon.edits("aabbccdd", "abcd", 3) == 4
    assert canon.near("braiilleprooff", "brailleproof") == pytest.approx(1.4) and canon.edits("ab", "ba", 2) == 1
    assert canon.near("bbrraaiilleproof", "brailleproof") == float("inf")


# --- 6 ----------------------------------------------------------------------------------------------------------------


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [[r.choice(vocabulary) for _ in range(r.randint(25, 120))] for _ in range(60)]
    data = []
    for i, t in enumerate(texts):
        data.append((f"a{i:03}", " ".join(t)))
        copy = list(t)
        for _ in range(r.randint(0, max(1, len(t) // 12))):
            copy[r.randrange(len(copy))] = r.choice(vocabulary)
        data.append((f"b{i:03}", " ".join(copy).upper() + "."))
    data += [("copy1", data[0][1]), ("copy2", data[0][1]), ("short", "one two three"), ("none", None), ("empty", ""), data[3]]
    d = spark.createDataFrame(data, "id string, t string")
    sets = {}
    for k, t in data:
        w = neardup.words(t)
        if len(w) >= neardup.MIN_WORDS:
            sets[k] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    want = {(x, y): len(sets[x] & sets[y]) / len(sets[x] | sets[y]) for x in sets for y in sets if x < y}
    want = {k: v for k, v in want.items() if v >= 0.6}
    got = {(x.id_a, x.id_b): x.similarity for x in neardup.similar_pairs(d, "id", "t").collect()}
    assert {k for k, v in want.items() if v >= 0.65} <= set(got) <= set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got) and ("copy1", "copy2") in got
    assert neardup.similar_pairs(d.limit(0), "id", "t").count() == 0
    text_of = dict(data)
    classes = {x.id: (x.class_id, x.copies, x.links) for x in neardup.memberships(d, "id", "t").collect()}
    assert set(classes) == set(sets)
    for k, (c, n, m) in classes.items():
        same = sorted(x for x in sets if text_of[x] == text_of[k])
        assert (c, n) == (same[0], len(same)) and m == len({text_of[y if x == k else x] for x, y in got if k in (x, y)} - {text_of[k]})


def test_crowded_buckets_are_salted(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET", 3)
    base = [f"w{i}" for i in range(60)]
    d = spark.createDataFrame([(f"c{i:02}", " ".join([*base, f"own{i}"])) for i in range(25)], "id string, t string")
    assert neardup.similar_pairs(d, "id", "t").count() == 25 * 24 // 2


def test_embedding_is_a_lower_bound():
    s = neardup.Sketcher(3, 5)
    r = random.Random(1)
    for _ in range(50):
        t = [f"w{r.randint(0, 60)}" for _ in range(60)]
        u = t[: r.randint(20, 60)] + [f"v{r.randint(0, 9)}" for _ in range(5)]
        a, b = " ".join(t), " ".join(u)
        x, y = (np.frombuffer(s.sketch(v)[1], dtype=np.uint8).astype(int) for v in (a, b))
        assert np.abs(x - y).sum() <= len(set(s.fingerprint(a)) ^ set(s.fingerprint(b)))


# --- 7 ----------------------------------------------------------------------------------------------------------------

SAMPLES = {
    "en": ["the team checked all the papers before the trucks left the yard that morning", "she wrote the guide that everybody in the office still uses for their work", "we kept a log of near misses and presented it to the board each quarter"],
    "de": ["jeden morgen habe ich die papiere geprüft und an die kollegen im lager weitergegeben", "außerdem habe ich neue mitarbeiter geschult die heute selbst die listen betreuen", "durch neue absprachen konnten wir die rechnungen deutlich schneller als früher bearbeiten"],
    "fr": ["chaque matin je vérifiais les papiers avant de les transmettre à ceux qui dirigeaient le quai", "nous avons pu traiter les factures bien plus vite qu'avant avec cette équipe", "il a aussi formé des employés qui s'occupent maintenant seuls de suivre les fiches"],
}


def test_languages(spark):
    r = random.Random(7)
    say = lambda lang, n: " ".join(f"{r.choice(SAMPLES[lang]).capitalize()} {r.randint(1, 99)}." for _ in range(n))
    data = [(f"{lang}{i}", say(lang, 5), {"en": "en-GB", "de": "GER", "fr": "fra"}[lang]) for lang in SAMPLES for i in range(40)]
    data += [("mixed", say("en", 3) + "\n" + say("de", 2), "en"), ("wrong", say("fr", 4), "en"), ("blank", say("de", 4), "  "), ("null", say("en", 3), None), ("none", None, "en"), ("empty", "", "en"), ("stub", "Too short", None)]
    c = spark.createDataFrame(data, "id string, raw_text string, language string")
    j = spark.createDataFrame([("j1", say("de", 4), "en"), ("j2", "Error 404\nnot found", "de"), ("j3", None, None)], c.schema)
    got = {(x.record_table, x.id, x.lang) for x in langid.undenoted(c, j).collect()}
    assert got == {("candidates", "mixed", "de"), ("candidates", "wrong", "fr"), ("candidates", "blank", "de"), ("candidates", "null", "en"), ("jobs", "j1", "de")}
    seg = langid.segments(c.where("id = 'mixed'"), "id", "raw_text", langid.fit(c, "id", "raw_text", "language")).orderBy("span_start").collect()
    assert [s.lang for s in seg] == ["en", "de"] and all(0 < s.confidence <= 1 for s in seg)
    assert langid.undenoted(c.limit(0), j.limit(0)).count() == 0


def test_labels(spark):
    forms = {"EN": "en", "de-AT": "de", " pt_BR ": "pt", "german": "de", "und": None, "": None, "unknown": None, "dut": "nl"}
    d = spark.createDataFrame([(k,) for k in forms], "l string")
    assert {r.l: r.x for r in d.select("l", langid.denoted(F.col("l")).alias("x")).collect()} == forms


# --- 8 ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    with open(bpe.VOCABULARY, encoding="utf-8") as f:
        return bpe.Encoder(f.read())


def test_encoder_equals_the_library(encoder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    r = random.Random(8)
    texts = ["", " ", "Hello  world\n\n", "<|endoftext|>", "é́ 😀👍🏽 \x00 ​", "=" * 500, "a" * 3000]
    texts += ["".join(r.choice("abeinorst -='éй\n") for _ in range(r.randint(1, 60))) for _ in range(2000)]
    texts += ["".join(chr(r.randint(1, 0xD7FF)) for _ in range(20)) for _ in range(300)]
    assert [encoder.encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert all(encoder.decode(encoder.encode(x)) == x for x in texts)


def test_encoding_frames(spark):
    d = spark.createDataFrame([(1, "some text"), (2, None), (3, ""), (1, "some text")], "doc_id int, text string")
    ids = d.select("doc_id", bpe.token_ids(d, "text").alias("ids"))
    got = [(r.doc_id, r.ids) for r in ids.orderBy("doc_id").collect()]
    assert got[0] == got[1] and got[2][1] == [] and got[3][1] == []
    assert sorted(r.t for r in ids.select(bpe.decoded(ids, "ids").alias("t")).collect()) == ["", "", "some text", "some text"]


# --- 9 ----------------------------------------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    r = random.Random(9)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(40)) + ".") for i in range(8)]
    docs = []
    for k in range(150):
        w = [r.choice(vocabulary) for _ in range(50)]
        if k % 2:
            source = items[k % 8][1].rstrip(".").split()
            n, at = r.randint(8, 20), r.randint(0, 20)
            w[10 : 10 + n] = source[at : at + n]
        docs.append((k, ", ".join(w).upper() if k % 3 else "\n".join(w)))
    docs += [(900, None), (901, ""), (902, "short"), (1, docs[1][1])]
    runs = lambda t: neardup.words(t)
    grams = {tuple(runs(t)[i : i + 12]): k for k, t in items for i in range(len(runs(t)) - 11)}
    want = {(k, grams[g]) for k, t in docs if t for i in range(len(runs(t)) - 11) if (g := tuple(runs(t)[i : i + 12])) in grams}
    d, e = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = leaks.leaks(d, "doc_id", "text", e, "item_id", "text").where("longest_run >= 12")
    assert set(map(tuple, got.select("doc_id", "item_id").collect())) == want and got.count() == len(want)
    assert leaks.leaks(d, "doc_id", "text", e.limit(0), "item_id", "text").count() == 0
    assert leaks.leaks(d.limit(0), "doc_id", "text", e, "item_id", "text").count() == 0


def test_edited_copies_are_aligned(spark):
    r = random.Random(91)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(40))) for i in range(6)]
    docs = []
    for k in range(60):
        w = items[k % 6][1].split()
        for at in range(r.randint(0, 8), 40, 9):  # one word in nine is another one: no run of twelve is left
            w[at] = "edited"
        docs.append((k, " ".join(r.choice(vocabulary) for _ in range(20)) + " " + " ".join(w)))
    docs += [(1000 + k, " ".join(r.choice(vocabulary) for _ in range(60))) for k in range(60)]
    d, e = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = {(x.doc_id, x.item_id): (x.score, x.longest_run) for x in leaks.leaks(d, "doc_id", "text", e, "item_id", "text").collect()}
    assert set(got) == {(k, k % 6) for k in range(60)}
    assert all(s >= 50 and n < leaks.RUN for s, n in got.values())


def test_alignment_equals_plain_table():
    r = np.random.default_rng(3)
    pairs, want = [], []
    for k in range(30):
        a, b = r.integers(0, 5, 15 - k % 4), r.integers(-1, 5, 20 - k % 7)
        h = np.zeros((len(a) + 1, len(b) + 1))
        run = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                same = a[i - 1] == b[j - 1]
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if same else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
                run[i, j] = run[i - 1, j - 1] + 1 if same else 0
        pairs.append((a, b))
        want.append((h.max(), run.max()))
    score, longest = leaks.align([a for a, _ in pairs], [b for _, b in pairs])
    assert list(zip(score, longest)) == want
    assert all((x[0][0], x[1][0]) == w for w, (a, b) in zip(want, pairs) for x in [leaks.align([a], [b])])


# --- 10 ---------------------------------------------------------------------------------------------------------------


def test_cut_texts(spark):
    r = random.Random(10)
    forms = ["You decide together with the {} which {} come first.", "The post covers {}, some travel and one late {} every month.", "We expect careful notes on {} and a friendly tone with the {}."]
    a, b = ["seed bank", "night shift", "cold store", "harbour gate"], ["sample logs", "price lists", "route sheets"]
    say = lambda n: " ".join(r.choice(forms).format(r.choice(a), r.choice(b)) for _ in range(n))
    whole = [say(4) for _ in range(300)] + [say(2).rstrip(".") for _ in range(20)] + [say(2) + "\nSkills\nKorvane, Plinthos" for _ in range(20)]
    cut = []
    for _ in range(60):
        t = say(4)
        at = r.randint(40, len(t) - 12)
        while not (t[at - 1].isalpha() and t[at] not in ".,") or t[:at].endswith(("seed bank", "shift", "store", "gate", "logs", "lists", "sheets", "notes", "travel", "month", "first")):
            at -= 1
        cut.append(t[:at] + r.choice(["", "", "…", "..."]))
    data = [(i, t, "s") for i, t in enumerate(whole)] + [(1000 + i, t, "c") for i, t in enumerate(cut)] + [(5000, None, "s"), (5001, "", "s"), (5002, " \n", "s"), (5003, "see https://x.test/a", "s")]
    d = spark.createDataFrame(data, "doc_id int, text string, source string")
    got = {x.doc_id for x in cutoff.cut_texts(d, "doc_id", "text").collect()}
    assert not {g for g in got if g < 1000 or g >= 5000}
    assert len(got) >= 0.9 * len(cut)
    share = {x.source: x.cut for x in cutoff.by_source(d, "doc_id", "text", "source").collect()}
    assert share == {"s": 0, "c": len(got)}
    assert cutoff.cut_texts(d.limit(0), "doc_id", "text").count() == 0


def test_cut_behind_an_elision_or_a_closing_sign(spark):
    whole = [f"Nous avons pu traiter les lots d'{x} avec soin. Le stock de 5 % du dépôt (zone {i}) est tenu par nous." for i, x in enumerate(["orge", "avoine", "épices", "huile"] * 10)]
    whole += [f"Le dépôt est loin (voir le plan {i})" for i in range(10)]
    cut = ["Le stock est tenu. Nous avons pu traiter les lots d'", "Le stock est tenu. Nous avons pu traiter les lots d’", "Nous avons pu traiter. Le stock de 5 %"]
    done = ["Le stock est tenu par nous (voir le plan 3)", "Nous avons pu traiter les lots d'orge avec soin."]
    d = spark.createDataFrame(list(enumerate(whole + cut + done)), "doc_id int, text string")
    assert {x.doc_id for x in cutoff.cut_texts(d, "doc_id", "text").collect()} == {50, 51, 52}
