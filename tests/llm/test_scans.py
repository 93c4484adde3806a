import collections
import random
import re

import pytest
from samples import cases
from helixmill.llm.licenses import TEMPLATES, scan
from helixmill.llm.pii import BASE, PATTERNS, find_pii, joined
from helixmill.llm.quality import quality

BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def test_pii_is_python_re(spark, docs, no_docs):
    r = random.Random(3)
    bits = [*"a.b-_1203 +()@%", "1.2.3.4", "@x.com", "4111 1111 1111 1111", "+1 (017) 555-7713", "é", "😀", "300.1.2.3"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(600)] + [None, ""]
    rows = find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", joined(*BASE).alias("spans")).collect()
    for row in rows:
        t = texts[row.doc_id] or ""
        assert row.spans == ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE_PATTERNS.items() for m in re.finditer(p, t) if holds(k, m[0])), t
    assert find_pii(docs).count() == len(cases()) and find_pii(no_docs).count() == 0


def test_pii_spans_and_scores_of_every_case(spark, docs, no_docs):
    """All columns of the hard cases, and scores by hand: context is the 40 characters before a span, across pieces and other spans."""
    from helixmill.llm.pii import CHUNK, CONTEXT, PRIOR

    got = find_pii(docs).select("doc_id", joined(*PATTERNS).alias("spans"), *PATTERNS).collect()
    assert len(got) == len(cases()) and find_pii(no_docs).select(joined(*PATTERNS)).count() == 0
    r = random.Random(8)
    bits = ["contact ", "mail", " phone ", "Host ", "zz", "é" * 7, "😀", " a@b.co ", " 10.0.0.1 ", "\n", "q" * (CHUNK - 30), " +1 555 123 4567 "]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(80))) for _ in range(60)]
    for row in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        for kind in BASE:
            for x in row[kind]:
                near = row.text[max(0, x.start - 40) : x.start].lower()
                assert abs(x.score - min(1.0, PRIOR[kind] + 0.3 * bool(re.search(CONTEXT[kind], near)))) < 1e-9


def test_pii_of_very_many_spans(spark):
    """Positions of 40,000 addresses in one text, in time that grows with the text."""
    text = " ".join(f"mail é u{i}@x{i}.com" for i in range(40_000))
    row = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(x.start, x.end) for x in row.email] == [m.span() for m in re.finditer(BASE_PATTERNS["email"], text)]


def test_pii_added_kinds_and_long_texts(spark):
    texts = ["a" * 200_000, "1" * 200_000, "1 " * 50_000, "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not GB83WEST12345698765432", "my ssn 078-05-1120, part 078-05-1121", "part no 078-05-1120 only"]
    got = [r.spans for r in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").select(joined(*PATTERNS).alias("spans")).collect()]
    assert got == ["", "", "", "iban:0:27,iban:32:54", "ssn:7:18,ssn:25:36", ""]


def shingles_of(text):
    w = re.findall("[a-z0-9\\x80-\U0010ffff]+", (text or "").lower())
    return [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []


def contained(text, template):
    """By hand: the greatest share of the template's distinct shingles in any stretch of 1.25 template lengths."""
    mine, s = shingles_of(template), shingles_of(text)
    reach = max(len(mine), int(1.25 * len(mine)))
    return max((len({*s[p : p + reach]} & {*mine}) / len({*mine}) for p in range(len(s)) if s[p] in mine), default=0.0)


def test_licenses(spark, docs, no_docs):
    filler = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 5
    texts = [filler + t + " " + filler for t in TEMPLATES.values()] + [filler, None, "", TEMPLATES["MIT-notice"] + " " + filler + TEMPLATES["MIT-notice"]]
    found = {}
    for row in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        found.setdefault(row.doc_id, []).append((row.license, row.containment))
    for i, name in enumerate(TEMPLATES):
        assert (name, 1.0) in found[i]
    n = len(TEMPLATES)
    assert not {n, n + 1, n + 2} & {*found} and found[n + 3] == [("MIT-notice", 1.0)] * 2
    assert scan(docs).count() == 0 and scan(no_docs).count() == 0


def test_licenses_are_brute_force(spark):
    """Whole license texts with words changed, left out and added, at shares of every size around the limit."""
    r = random.Random(6)
    texts, inside = [], 0
    for k in range(150):
        name = r.choice(list(TEMPLATES))
        words_of, out = TEMPLATES[name].split(), []
        rate = r.choice([0, 0.01, 0.03, 0.045, 0.06])
        for w in words_of:
            kind = r.random() / max(rate, 1e-9)
            out += [w] if kind > 1 else [] if kind > 0.66 else [w, "added"] if kind > 0.33 else ["changed"]
        texts.append(" ".join([f"before{k}"] * r.randrange(40) + out + ["after"] * r.randrange(40)))
    got = {}
    for row in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        got[row.doc_id, row.license] = max(got.get((row.doc_id, row.license), 0), row.containment)
    for i, t in enumerate(texts):
        for name, template in TEMPLATES.items():
            share = contained(t, template)
            assert (share >= 0.8) == ((i, name) in got) and (share < 0.8 or abs(share - got[i, name]) < 1e-12), (i, name, share)
            inside += 0.8 <= share < 1
    assert inside > 40


def counts(text):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    text = text or ""
    w = word.findall(text)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    times = collections.Counter(windows)
    covered = {i for k, x in enumerate(windows) if times[x] > 1 for i in range(k, k + 5)}
    lines = [x for x in text.split("\n") if word.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len({*lines}), len(covered)


def test_quality(spark, docs, no_docs):
    texts = {i: t for i, t in enumerate([*(r[1] for r in cases()), "a b c d e " * 4, "a b c d e x y a b c d e a b", "## | ** x\n\n## | ** x"])}
    rows = quality(spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    assert len(quality(docs).collect()) == len(cases()) and quality(no_docs).collect() == []
    assert all(x.kept != x.base_failed for x in quality(docs.withColumn("lang", docs.lang.substr(9, 1)).replace("", None, ["lang"])).collect())  # no references


def test_common_words_are_those_of_all_documents(spark):
    """More documents of a language than were once sampled, with words of almost the same frequency; and one document of another."""
    from helixmill.llm.quality import COMMON_WORDS, common_words

    r = random.Random(11)
    rows = [(i, " \n".join(f"W{r.randrange(64)}" for _ in range(4)) + "\t", "en") for i in range(5000)]
    rows += [(5000, " q Q\vp", "fr"), (5001, "zz " * 500, None), (5002, None, "en"), (5003, " ", "de")]
    times = collections.Counter(w.lower() for _, t, lang in rows if lang == "en" and t for w in t.split())
    want = {"en": sorted(sorted(times, key=lambda w: (-times[w], w))[:COMMON_WORDS]), "fr": ["p", "q"]}
    assert {x.language: x.words for x in common_words(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == want


def test_quality_rejects_symbols(spark):
    from samples import words

    rows = [(i, words(i, 200), "en") for i in range(20)] + [(99, " ".join(w + "&&&" for w in words(50, 200).split()), "en")]
    kept = {r.doc_id: r.kept for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not kept.pop(99) and all(kept.values())


@pytest.mark.parametrize("kind", PATTERNS)
def test_pii_patterns_are_possessive_or_bounded(kind):
    assert "++" in PATTERNS[kind] or kind in ("phone", "iban", "ssn")


COMMON = "the of and to in is it that for on with as are was be this by at from or".split()


def test_quality_rejects_word_salad(spark):
    """Long texts with no or few common words, or with one of them only; lengths are guarded by n_words, not by common words."""
    from helixmill.llm.quality import MIN_COMMON_WORDS

    r = random.Random(7)
    made = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) + "x"
    prose = lambda n: " ".join(r.choice(COMMON) if r.random() < 0.35 else made() for _ in range(n))
    rows = [(i, prose(r.randint(100, 500)), "en") for i in range(200)] + [(1000, prose(3000), "en"), (1001, prose(3000), None), (1002, " ".join(made() for _ in range(12)), None)]
    salad = [made() for _ in range(3000)]
    rows += [(2000, " ".join(salad), None), (2001, " ".join(made() for _ in range(400)), "en"), (2002, " ".join(salad[:1500] + COMMON[:11] + salad[1500:]), None)]
    rows += [(2003, " ".join(w if k % 3 else "the" for k, w in enumerate(salad)), None)]
    got = {x.doc_id: x for x in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(x.class_distance is None or x.class_distance <= 0.25 for x in got.values()) and not any(x.base_failed for x in got.values())
    assert {i for i, x in got.items() if not x.kept} == {2000, 2001, 2002, 2003}
    assert all((x.common_distance is None) == (x.n_words < MIN_COMMON_WORDS) for x in got.values())


def test_quality_distances_are_brute_force(spark, monkeypatch):
    """Words, references, distances to the own or the nearest language, limits and verdicts by hand."""
    import math

    from helixmill.llm import quality as q

    r = random.Random(4)
    letters = {"aa": "abcdefgh", "bb": "qrstuvwx", "cc": "éàbcßñ"}
    lists = {lang: ["".join(r.choice(a) for _ in range(r.randint(1, 3))) for _ in range(25)] for lang, a in letters.items()}

    def text(lang, n):
        return " ".join(r.choice(lists[lang]) if r.random() < 0.5 else "".join(r.choice(letters[lang]) for _ in range(7)).capitalize() for _ in range(n))

    rows = [(i, text(["aa", "bb", "cc"][i % 3], r.choice([3, 20, 40, 90, 200])), ["aa", "bb", "cc"][i % 3]) for i in range(150)]
    rows += [(200, text("aa", 150), "bb"), (201, text("cc", 150), None), (202, "1234 %% " * 3 + text("bb", 60).upper(), "bb"), (203, "z" * 300, "aa"), (204, None, "aa"), (205, text("bb", 90), "dd"), (206, "", None)]
    word = re.compile(q.WORD)
    top, docs = collections.defaultdict(collections.Counter), {}
    for i, t, lang in rows:
        docs[i] = (t or "", lang)
        if lang and t is not None:
            top[lang].update(word.findall(t.lower()))
    words_of = {lang: sorted(sorted(c, key=lambda w: (-c[w], w))[: q.COMMON_WORDS]) for lang, c in top.items() if c}

    def classes(t):
        kinds = [0] * 6
        for c in t:
            kinds[1 if c.isupper() else 0 if c.isalpha() else 2 if c in "0123456789" else 3 if c in " \t\n\v\f\r" else 4 if c in "#*$%&|<>" else 5] += 1
        return kinds

    def histogram(t, lang):
        c = collections.Counter(word.findall(t.lower()))
        own = [c[w] for w in words_of[lang]]
        return [*own, c.total() - sum(own)]

    share = lambda h: [x / sum(h) for x in h]
    entropy = lambda p: -sum(x * math.log2(x) for x in p if x > 0)
    distance = lambda p, s: math.sqrt(max(0.0, entropy([(x + y) / 2 for x, y in zip(p, s, strict=True)]) - (entropy(p) + entropy(s)) / 2))
    failed = {i: (len(word.findall(t)) < 10 or 100 * counts(t)[4] > 20 * len(word.findall(t))) for i, (t, _) in docs.items()}
    refs = {}
    for lang in words_of:
        good = [t for i, (t, own) in docs.items() if own == lang and not failed[i]]
        if good:
            refs[lang] = tuple(share([sum(x) for x in zip(*map(f, good), strict=True)]) for f in (classes, lambda t, lang=lang: histogram(t, lang)))
    got = {x.doc_id: x for x in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {*refs} == {"aa", "bb", "cc", "dd"}
    for i, (t, lang) in docs.items():
        use = [lang] if lang in refs else [*refs]
        want = min(distance(share(classes(t)), refs[x][0]) for x in use) if len(t) >= q.MIN_CHARS else None
        assert (got[i].class_distance is None) == (want is None) and (want is None or abs(got[i].class_distance - want) < 1e-9), i
        want = min(distance(share(histogram(t, x)), refs[x][1]) for x in use) if len(word.findall(t)) >= q.MIN_COMMON_WORDS else None
        assert (got[i].common_distance is None) == (want is None) and (want is None or abs(got[i].common_distance - want) < 1e-9), i
        assert got[i].base_failed == failed[i]
    assert not got[200].kept and got[201].kept  # another language than its own; none of its own
    monkeypatch.setattr(q, "LITERAL_WORDS", 10)
    fixed = {x.doc_id: x for x in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_common_distance=0.4).collect()}
    assert all(fixed[i].common_distance == x.common_distance for i, x in got.items())
    for i, x in fixed.items():
        assert x.kept == (not failed[i] and (x.class_distance or 0) <= q.MAX_CLASS_DISTANCE and (x.common_distance or 0) <= 0.4)


def test_licenses_in_texts_shorter_than_a_window(spark):
    gpl, ccby = TEMPLATES["GPL-3.0-notice"].split(), TEMPLATES["CC-BY-SA-4.0-notice"].split()
    texts = [" ".join(gpl[:-1]), " ".join(gpl[:10]), " ".join(ccby[1:]), "x " + " ".join(gpl[:-1]), " ".join(ccby[:9])]
    got = {(r.doc_id, r.license, r.first_word, round(r.containment, 4)) for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {(i, name, round(contained(t, template), 4)) for i, t in enumerate(texts) for name, template in TEMPLATES.items() if contained(t, template) >= 0.8}
    assert {(i, name, share) for i, name, _, share in got} == want and (0, "GPL-3.0-notice", 0, 0.875) in got


@pytest.mark.parametrize("shape", ["{span}{x}", "{i}{div}", "{i}{b}", "{ptable}"])
def test_nesting_is_read_in_linear_time(shape):
    """20,000 nested or unmatched tags take well under a second; nothing walks the stack of open tags."""
    import time

    from helixmill.llm.html_extract import Page

    n = 20_000
    source = shape.format(span="<span>" * n, x="</x>" * n, i="<i>" * n, div="<div>a</div>" * n, b="</b>" * n, ptable="<p><table>" * n)
    began = time.process_time()
    page = Page(source)
    assert len(page.parent) > n and time.process_time() - began < 1.5
    assert not any(page.open_at.values())


def test_whole_long_licenses(spark):
    """Texts of real length: whole, in prose, with a word in 60 changed, half of one, and two after one another."""
    from helixmill.llm.license_texts import FILES

    r = random.Random(12)
    assert all(len(t) > 5000 for t in FILES.values())

    def edited(text, every):
        w = text.split()
        for k in range(r.randrange(every), len(w), every):
            w[k] = f"changed{k}"
        return " ".join(w)

    names = sorted(FILES)
    texts = [*(FILES[n] for n in names), *("Some prose before it. " * 30 + edited(FILES[n], 60) + " and after it." * 40 for n in names), *(FILES[n][: len(FILES[n]) // 2] for n in names), FILES["GPL-3.0-text"] + "\n" + FILES["Apache-2.0-text"], *(edited(FILES[n], 6) for n in names)]
    found = collections.defaultdict(dict)
    for row in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect():
        if row.license in FILES:
            found[row.doc_id][row.license] = row
    n = len(names)
    for k, name in enumerate(names):
        assert found[k][name].containment == 1.0 and found[k][name].first_word == 0
        assert set(found[n + k]) == {name} and 0.85 < found[n + k][name].containment < 0.95 and found[n + k][name].first_word >= 100
        assert name not in found[2 * n + k] and not found[3 * n + 1 + k]
    assert {"GPL-3.0-text", "Apache-2.0-text"} == set(found[3 * n])


def test_quality_limits_are_brute_force(spark):
    """The word limits are recomputed from the measured distances: per octave of length, upper quartile plus three times the interquartile range of the scaled, binned distances of the reference documents, with the nearest
    octaves pooled until there are enough."""
    import math

    from helixmill.llm import quality as q

    r = random.Random(21)
    pool = "the of and to in is that it was for on with as at by from this be are have or an not but they which one all were there we when your can said use each how their if will up other about out many then them these so some her would make like him into time has look two more".split()
    prose = lambda n: " ".join(r.choices(pool, [1 / (k + 1) for k in range(len(pool))], k=n))
    rows = [(i, prose(int(2 ** r.uniform(3, 9))), "en") for i in range(260)]
    rows += [(1000 + i, " ".join("".join(r.choice("aeioustrn") for _ in range(r.randint(3, 8))) for _ in range(200)), r.choice(["en", None])) for i in range(6)]
    got = q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    lang = {i: name for i, _, name in rows}
    scaled, per = {}, collections.defaultdict(list)
    for x in got:
        octave = x.n_words.bit_length()
        if x.common_distance is not None:
            scaled[x.doc_id] = x.common_distance * math.sqrt(x.n_words / 2 ** (octave - 1))
            if lang[x.doc_id] is not None and not x.base_failed:
                per[octave].append(math.floor(scaled[x.doc_id] * q.DISTANCE_BINS))
    limits = {}
    for octave in per:
        pooled = []
        for other in sorted(per, key=lambda o: (o > octave, abs(o - octave))):
            pooled += [math.ceil(k * max(1.0, 2 ** ((other - octave) / 2))) for k in per[other]]
            if len(pooled) >= q.LEAST_REFERENCES:
                break
        if len(pooled) >= q.LEAST_REFERENCES:
            pooled.sort()
            quartile = lambda share: (pooled[math.ceil(share * len(pooled)) - 1] + 1) / q.DISTANCE_BINS
            limits[octave] = quartile(0.75) + q.FENCE * (quartile(0.75) - quartile(0.25))
    assert len(limits) >= 3
    for x in got:
        known = [o for o in limits if o <= x.n_words.bit_length()]
        far = x.doc_id in scaled and bool(known) and scaled[x.doc_id] > limits[max(known)]
        assert x.kept == (not x.base_failed and not far and (x.class_distance or 0) <= q.MAX_CLASS_DISTANCE)
    assert not any(x.kept for x in got if x.doc_id >= 1000) and sum(x.kept for x in got) > 200
