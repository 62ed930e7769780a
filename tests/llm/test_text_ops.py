import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from imgspark.llm import importance, licences, mixing, quality, spans, trie, urlglob

SCHEMA = "doc_id long, text string, lang string, source string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randint(0, 30)) for _ in range(n))


# ---- sentence spans


def slow_mix(x):
    m = 2**64 - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
    return x ^ (x >> 31)


def slow_pieces(text):
    """(first, last + 1) of each piece, as places of words, and the words."""
    text = (text or "").lower()
    words, breaks = [], set()
    for line in text.split("\n"):
        words += line.split()
        breaks.add(len(words))
    ends = lambda w: bool(re.search(r"[.!?][^\w]*$", w))
    code = [xxhash.xxh3_64_intdigest(w.encode()) >> 1 << 1 | ends(w) for w in words]
    whole = [i for i in range(1, len(words) + 1) if i in breaks or i == len(words) or ends(words[i - 1])]
    out, begin = [], 0
    for end in whole:
        cuts = [c for c in range(begin + 4, end - 3) if slow_mix((code[c - 1] + 3 * code[c - 2]) % 2**64) % 3 == 0]
        for x, y in zip([begin, *cuts], [*cuts, end]):
            out += [(z, min(z + 16, y)) for z in range(x, y, 16)]
        begin = end
    return out, words


def brute_spans(rows):
    """Kept texts by the definition, one document after another in order of id."""

    def found(text):
        parts, words = slow_pieces(text)
        out, n = set(), len(parts)
        closes = lambda a, b: b - a >= 2 and parts[b - 1][1] - parts[a][0] >= 16
        for a in range(n):
            out |= {(a, b) for b in range(a + 1, n + 1) if closes(a, b) and not closes(a, b - 1)}
        for b in range(1, n + 1):
            out |= {(a, b) for a in range(b) if closes(a, b) and not closes(a + 1, b)}
        return [(a, b, tuple(words[parts[a][0] : parts[b - 1][1]])) for a, b in sorted(out)], parts

    first = {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        for _, _, key in found(text)[0]:
            first.setdefault(key, doc)
    out = {}
    for doc, text in rows:
        (got, parts), seen, gone = found(text), set(), set()
        for a, b, key in got:
            if first[key] != doc or key in seen:
                gone.add((a, b))
            seen.add(key)
        under = {i for a, b in gone for i in range(a, b)}
        # neighbours under runs are one span; so are runs that only touch
        drop = []
        for i in sorted(under):
            if drop and drop[-1][-1] == i - 1:
                drop[-1].append(i)
            else:
                drop.append([i])
        places = {w for d in drop if parts[d[-1]][1] - parts[d[0]][0] >= 39 for i in d for w in range(*parts[i])}
        tokens = re.findall(r"\S+\s*", text or "")
        blank = re.match(r"\s*", text or "")[0]
        out[doc] = blank + "".join(t for i, t in enumerate(tokens) if i not in places) if places else text
    return out


def span_rows():
    rng = random.Random(1)
    sentence = lambda: words(rng, rng.choice([1, 2, 5, 9, 14, 30, 60])) + rng.choice([". ", ".\n", "!%% ", "? ", "\n"])
    passages = ["".join(sentence() for _ in range(rng.randint(3, 6))) for _ in range(6)] + [words(rng, 60) + ". ", words(rng, 30) + ". " + words(rng, 12) + " "]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "One. Two. Three."), (4, " was" * 70), (5, "x " + "was " * 90), (6, "Y. " + "Was\t" * 90)]
    for i in range(7, 80):
        text = "".join(rng.choice(passages) if rng.random() < 0.2 else sentence() for _ in range(rng.randint(1, 12)))
        rows.append((i, text))
    return rows + [(90, rows[20][1]), (91, rows[20][1].upper()), (92, "  " + rows[20][1].replace(" ", "   "))]


def test_spans_equal_brute_force(spark):
    rows = span_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in spans.dedup_spans(df).collect()}
    want = brute_spans(rows)
    assert {d: r._s_text for d, r in got.items()} == want
    assert sum(t != dict(rows)[d] for d, t in want.items()) > 30
    for d, r in got.items():  # the spans are what is missing
        left, upto = "", 0
        for s in r._s_spans:
            left, upto = left + r.text[upto : s.start], s.end
        assert r._s_removed == 0 or left + r.text[upto:] == r._s_text


@pytest.mark.parametrize("parts", [1, 2, 4, 9])
def test_long_passages_are_caught(spark, parts):
    """Every passage of over 50 words between sentence ends stays in one place only, and nothing else goes."""
    rng = random.Random(2)
    passage = "".join(words(rng, -(-54 // parts)) + ". " for _ in range(parts))
    rows = [(i, words(rng, 30) + ". " + passage + words(rng, 30) + ".") for i in range(5)]
    kept = {r.doc_id: r._s_text for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [passage in kept[i] for i in range(5)] == [True, False, False, False, False]
    assert all(rows[i][1].split(". ")[0] in kept[i] and kept[i].endswith(rows[i][1].split(". ")[-1]) for i in range(5))


@pytest.mark.parametrize("size", [51, 52, 55, 60, 80])
@pytest.mark.parametrize(("low", "high"), [(3, 8), (8, 20), (15, 30), (25, 40), (40, 70)])
def test_passages_inside_sentences(spark, low, high, size):
    """A passage glued at both ends into other sentences, sentences of low to high words on both sides of it and in it."""
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"v{rng.randint(0, 10**9)}" for _ in range(n))
    sentences = lambda: " ".join(fresh(rng.randint(low, high)) + "." for _ in range(3))
    rows = []
    for g in range(200):
        w, at = fresh(size).split(), rng.randint(1, high)
        while at < size - 1:
            w[at] += "."
            at += rng.randint(low, high)
        for j in range(2):
            rows.append((2 * g + j, f"{sentences()} {fresh(rng.randint(1, high))} {' '.join(w)} {fresh(rng.randint(1, high))}. {sentences()}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed > 0 for r in spans.span_report(df).collect()}
    assert not any(got[2 * g] for g in range(200))
    assert sum(got[2 * g + 1] for g in range(200)) >= 180


def test_clean_documents_stay(spark):
    """Documents that share passages of at most 36 words, and many short sentences."""
    rng = random.Random(10)
    common = [words(rng, rng.randint(2, 6)) + ". " for _ in range(30)]
    passages = [words(rng, 12) + ". " + words(rng, 12) + ". " + words(rng, 12) + ". " for _ in range(5)]
    rows = [(i, "".join(rng.choice(common) + words(rng, 9) + str(i) + ". " for _ in range(20)) + "\n" + rng.choice(passages)) for i in range(200)]
    assert all(r.n_removed == 0 for r in spans.span_report(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_span_edges(spark):
    assert spans.dedup_spans(spark.createDataFrame([], "doc_id long, text string, k1 long")).collect() == []
    text = "".join(" ".join(f"{c}{i}" for i in range(14)) + ". " for c in "abc")
    rows = [(None, text), (None, text * 2), (7, text), (7, text), (8, text + text)]
    got = sorted((r.doc_id or -1, r._s_text, r.k1) for r in spans.dedup_spans(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, k1 long")).collect())
    assert got == [(-1, text, 5), (-1, text, 5), (7, text, 5), (7, text, 5), (8, "", 5)]
    with pytest.raises(ValueError):
        spans.dedup_spans(spark.createDataFrame([], "doc_id long, text string, _s_text string"))


# ---- URL filters


def test_url_contract_and_edges(spark):
    urls = ["http://A.Example.com/en/x?y#z", "https://www.example.com/en/", "https://b.www.example.com/en/q", "x://net/es/", "x://fakenet/es/", "x://a.net/fr/..", "x://a.net/fr", "http://com?x", "http://com/", "nourl", None, "", "http://spam-farm.org/", "http://foo.org/spam", "http://foo.org/a.example.com/en/", "a://b://c/d", "x://é.com/é?"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlglob.judge(df).collect()}
    assert got[0] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[1][2:] == ("www.example.com/en/", "allow") and got[2][2:] == ("www.example.com/en/", "allow")
    assert got[3][2:] == ("net/es/", "block") and got[4][2:] == (None, "allow") and got[5][2] == "net/fr/" and got[6][2] is None
    assert got[7] == ("com", "", None, "allow") and got[8][2:] == ("com/", "allow")
    assert got[9] == got[10] == got[11] == ("", "", None, "allow")
    assert got[12][3] == "block" and got[13][3] == "allow" and got[14][2:] == (None, "allow")
    assert got[15][:2] == ("b:", "//c/d") and got[16] == ("é.com", "/é", "com/", "allow")
    assert urlglob.judge(df.limit(0)).collect() == []


def test_url_words_at_borders(spark):
    """Words inside of other words, and pages of public bodies, are left alone; other spellings of a word are not."""
    fine = "pharmacy.arizona.edu/ replicationlab.edu/ spamassassin.apache.org/ www.annulled.org/ scampi.fr/ lottery.ny.gov/ casino.gov.uk/x badspecialist.org/ loads.org/ beds.org/downloads/ alphabets.org/ my.int/casino/ foo.org/spam/".split()
    bad = "foo.org/%63asino/ foo.org/Casino/x foo.org/big_casino.html a.org/x+casino+y foo.org/%43%41SINO x.casino/ www.casino-win.org/ CASINO.org:8080/ u@free-bets.org/ cheap-pills.org./ ads-track.org/ onlinecasino24.org/ spam-farm.org x.spam/".split()
    rows = [(i, "http://" + u) for i, u in enumerate(fine + bad)]
    got = {r.page_id: r.verdict for r in urlglob.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [u for i, u in rows if got[i] != ("allow" if i < len(fine) else "block")] == []


def test_globs_against_regex():
    import re

    rng = random.Random(1)
    part = {"*": ".*", "^": "[^/]*", "?": ".", "|": "[./-]"}
    for _ in range(60):
        globs = ["".join(rng.choices("abé./*^?|", k=rng.randint(1, 40))) for _ in range(9)]
        machine = urlglob.Automaton([urlglob.Rule(g, g, "x", 0) for g in globs])
        texts = ["".join(rng.choices("abé日./-", k=rng.randint(0, 14))) for _ in range(20)]
        want = [[bool(re.fullmatch("".join(part.get(c, re.escape(c)) for c in g), t)) for g in globs] for t in texts]
        assert machine.fits([t.encode() for t in texts]).tolist() == want


def test_default_rules_by_regex(spark):
    """The first of the method's own globs that fits the folded form, by regular expressions."""
    rng = random.Random(13)
    parts = [*urlglob.UNWANTED[::4], *urlglob.ANYWHERE[::4], "spam", "gov", "ac", "uk", "a", "", "é", "日本", "index.htm", "x-y", "News", "%63asino", "%ff", "u@", "po%6ber"]
    glue = ["/", ".", "-", "s", "é", "", "//", ".html", "_", "+", "%20", ":80/", "./"]
    rows = [(i, "http://" + "".join(rng.choice(parts) + rng.choice(glue) for _ in range(rng.randint(1, 6)))) for i in range(800)]
    form = {"*": ".*", "^": "[^/]*", "?": ".", "|": "[./-]"}
    tests = [(re.compile("".join(form.get(c, re.escape(c)) for c in r.glob), re.S), r.verdict) for r in urlglob.DEFAULTS]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in urlglob.judge(df, rules=[]).collect()}
    for i, u in rows:
        text = urlglob.folded(*urlglob.canonical(u))
        assert got[i].verdict == (next((v for t, v in tests if t.fullmatch(text)), "allow") if got[i].host or got[i].path else "allow"), u
    con = duckdb.connect()
    con.register("pages", pa.table({"page_id": [i for i, _ in rows], "url": [u for _, u in rows]}))
    want = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in con.sql(urlglob.SQL).to_arrow_table().to_pylist()}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlglob.judge(df).collect()} == want
    assert {r.verdict for r in got.values()} == {"block", "allow"}


# ---- mixing


def test_targets_equal_repeated_resharing(spark):
    rng = random.Random(3)
    for _ in range(4):
        sizes = {f"s{i:02}": rng.choice([0, 1, 5, 100, 10_000]) * rng.randint(1, 9) for i in range(rng.randint(1, 9))} | {None: 40}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        order = sorted((s for s in sizes if s is not None)) + [None]
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        total, capped = sum(sizes.values()), set()
        while True:
            left = total - sum(3 * sizes[s] for s in capped)
            free = sum(weight[s] for s in order if s not in capped)
            over = {s for s in order if s not in capped and left * weight[s] / free > 3 * sizes[s]}
            if not over:
                break
            capped |= over
        for s in order:
            want = 3 * sizes[s] if s in capped else left * weight[s] / free
            assert math.isclose(got[s], want, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(sum(got.values()), total)


def test_ranks_and_sums_over_ranges(spark):
    """Order and running sums over many ranges equal those in one place; so do targets of many sources."""
    from imgspark.llm.scratch import Scratch

    rng = random.Random(15)
    sizes = [(f"s{i}" if i else None, rng.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(sizes, "source string, size long").withColumn("cap", F.col("size").cast("double")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.source: (r._n, r._cap) for r in mixing.running(Scratch(spark, "t"), df, [F.col("source").asc_nulls_last()], ("cap",)).collect()}
        targets = [r.target for r in mixing.source_targets(df).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    upto = 0
    for n, (s, size) in enumerate(sorted(sizes, key=lambda x: (x[0] is None, x[0]))):
        assert got[s] == (n, upto)
        upto += size
    assert math.isclose(sum(targets), upto) and len(targets) == 3000


def test_clashing_columns_are_errors(spark):
    for f, c in ((mixing.mix_plan, "_mix_size"), (quality.keep_good, "_q_symbols"), (quality.keep_good, "_q")):
        with pytest.raises(ValueError):
            f(spark.createDataFrame([], SCHEMA + f", {c} long"))


def test_mixing_rows(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randint(0, 30)), "en", rng.choice(["a", "a", "a", "b", None])) for i in range(600)] + [(900, None, None, "b"), (None, "x y", "en", "a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_mix", F.lit(1)).withColumn("rate", F.lit(2))
    plan = mixing.mix_plan(df).collect()
    assert len(plan) == len(rows) and max(r._mix_copies for r in plan) <= 3
    for s in ("a", "b", None):
        own = [r for r in plan if r.source == s]
        taken, target = sum(r._mix_size * r._mix_copies for r in own), own[0]._mix_target
        assert abs(taken - target) <= 0.2 * target
    assert sorted((r.doc_id or -1, r._mix_copies) for r in mixing.mix_plan(df.repartition(7)).collect()) == sorted((r.doc_id or -1, r._mix_copies) for r in plan)
    out = mixing.mix_emit(df)
    assert out.columns == df.columns and out.count() == sum(r._mix_copies for r in plan)
    assert mixing.mix_plan(df.limit(0)).collect() == []


# ---- quality


def brute_metrics(text):
    text = text or ""
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text) if x]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality_metrics_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", "a", "a b", "a b c a b c a b c", "x\u00a0y \x1cz", "\u2028 é#|<>\n\té", "q\n\nq\n q\nq "]
    texts += ["".join(rng.choice(["a ", "b ", "c ", "\n", "# ", "dd ", "\x0b"]) for _ in range(rng.randint(1, 200))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)
    for r in quality.with_metrics(df).collect():
        assert (r._q_n_words, r._q_word_chars, r._q_n_symbols, r._q_n_dup_lines, r._q_n_repeat_words) == brute_metrics(texts[r.doc_id])


def test_quality_thresholds_follow_the_group(spark):
    rng = random.Random(6)
    unique = lambda i, n: " ".join(f"w{i}x{rng.randint(0, 10**6)}" for _ in range(n))
    rows = [(i, unique(i, 80), "en", "plain") for i in range(60)] + [(100 + i, unique(i, 80).replace("x", "#"), "en", "code") for i in range(60)]
    rows += [(300, unique(300, 80).replace("x", "#####"), "en", "plain"), (301, unique(301, 80), None, None), (302, None, "en", "plain"), (303, unique(303, 10), "en", "plain")]
    got = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] for i in range(60)) and all(got[100 + i] for i in range(60))
    assert [got[i] for i in (300, 301, 302, 303)] == [False, True, False, False]
    assert quality.quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []
    assert quality.keep_good(spark.createDataFrame(rows, SCHEMA)).count() == sum(got.values())


# ---- importance resampling


def test_importance(spark):
    rng = random.Random(7)
    good = lambda: " ".join(rng.choice(["the", "of", "and", "word"]) + str(rng.randint(0, 9)) for _ in range(40))
    bad = lambda: " ".join(rng.choice(["buy", "win", "$$$"]) + str(rng.randint(0, 9)) for _ in range(40))
    rows = [(i, good() if i % 4 else bad(), "en", "s") for i in range(400)] + [(900, None, None, None)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(200)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, SCHEMA)
    out = importance.importance_sample(df, labels).collect()
    kept = {r.doc_id for r in out if r.kept}
    held = [i for i in range(200, 400)]
    assert sum((i in kept) == (i % 4 > 0) for i in held) >= 0.97 * len(held)
    assert len(kept) == math.ceil(0.75 * 401)
    assert {r.doc_id for r in importance.importance_sample(df.repartition(5), labels).collect() if r.kept} == kept
    assert importance.importance_sample(df.limit(0), labels).collect() == []
    none = importance.importance_sample(df, labels.limit(0)).collect()
    assert all(r.kept for r in none)


def brute_importance(rows, labels, share):
    """{doc: (log weight, kept)} by plain counting, in the buckets of the definition."""
    n = importance.bucket_count(len(rows))

    def places(text):
        h = [xxhash.xxh3_64_intdigest(w.encode()) for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if w]
        one = [slow_mix((x + 1) % 2**64) for x in h]
        two = [slow_mix((slow_mix(x) + y) % 2**64) for x, y in zip(h, h[1:])]
        return [x * n >> 64 for x in one + two]

    good = {d for d, q in labels if q == 1 and d is not None}
    raw, target = [0] * n, [0] * n
    for doc, text in rows:
        for b in places(text):
            raw[b] += 1
            target[b] += doc in good
    weight = lambda b: math.log((target[b] + 1) / (sum(target) + n)) - math.log((raw[b] + 1) / (sum(raw) + n))
    out = []
    for doc, text in rows:
        w = sum(weight(b) for b in places(text))
        u = ((xxhash.xxh3_64_intdigest(str(-1 if doc is None else doc).encode()) >> 11) + 0.5) / 2**53
        out.append((doc, w, w - math.log(-math.log(u))))
    k = math.ceil(share * len(rows))
    least = sorted((x[2] for x in out), reverse=True)[k - 1] if k else math.inf
    return sorted(((-1 if d is None else d), round(w, 5), x >= least) for d, w, x in out)


def test_importance_equals_brute_force(spark):
    """Nulls, empty texts, repeated rows, ids that tie, extra columns with names of the result."""
    rng = random.Random(12)
    rows = [(i, words(rng, rng.randint(0, 60))) for i in range(150)] + [(None, words(rng, 9)), (None, None), (200, ""), (201, " \n"), (3, "Alpha1 BETA2 é"), (3, "Alpha1 BETA2 é"), (202, None)]
    labels = [(i, i % 3 % 2) for i in range(100)] + [(None, 1), (5, None), (3, 1)]
    df = spark.createDataFrame([(*r, 1.0, True) for r in rows], "doc_id long, text string, log_weight double, kept boolean").repartition(5)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    for share in (0.0, 0.3, 1.0):
        got = sorted(((-1 if r.doc_id is None else r.doc_id), round(r.log_weight, 5), r.kept) for r in importance.importance_sample(df, lab, share).collect())
        want = brute_importance(rows, labels, share)
        assert [(d, k) for d, _, k in got] == [(d, k) for d, _, k in want]
        assert all(math.isclose(a[1], b[1], abs_tol=2e-5) for a, b in zip(got, want))


def test_buckets_grow():
    assert [importance.bucket_count(n) for n in (0, 1, 16_384, 65_536, 10**6, 10**12)] == [2**14, 2**14, 2**14, 2**15, 2**17, 2**22]


def test_kth_largest_and_gumbel(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 100, 500), [0.0, -0.0, 5.0, 5.0, -1e300, 1e300]])
    k = importance.ordered(x)
    assert (np.argsort(k, kind="stable") == np.argsort(x + 0.0, kind="stable")).all()
    df = spark.createDataFrame([(int(v),) for v in k], "k long")
    for n in (1, 3, 250, len(x)):
        assert importance.kth_largest(df, "k", n) == sorted(k.tolist(), reverse=True)[n - 1]
    draws = np.array([importance.gumbel(i) for i in range(20_000)])
    assert abs(draws.mean() - 0.5772) < 0.03 and abs(draws.var() - math.pi**2 / 6) < 0.08


# ---- trie counts


def best_by_hand(word, pieces):
    best = [(0.0, 0)] + [None] * len(word)
    for d in range(1, len(word) + 1):
        for j in range(d):
            s = pieces.score.get(word[j:d])
            cand = [(best[j][0] + s, best[j][1] + 1)] if s is not None else []
            if j == d - 1 and word[j] not in pieces.score:
                n = len(word[j].encode())
                cand.append((best[j][0] + n * pieces.byte, best[j][1] + n))
            for c in cand:
                if best[d] is None or c[0] > best[d][0] or c[0] == best[d][0] and c[1] < best[d][1]:
                    best[d] = c
    return best[-1][1], best[-1][0]


def test_trie_equals_plain_dynamic_programming():
    rng = random.Random(8)
    pieces = trie.Pieces(["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab", "bb", "abab"])
    for most in (10**6, 40):
        t = trie.Trie(pieces, most)
        for _ in range(800):
            w = trie.MARK + "".join(rng.choices("abcé", [5, 5, 1, 1], k=rng.randint(0, 12)))
            assert t.tokens(w) == pytest.approx(best_by_hand(w, pieces))
            assert len(t.best) <= most + 20


def test_token_counts(spark):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [None, "", "  ", "hello world", "hello  world\n", "日本 \x00", "x" * 20_000]
    got = {r.doc_id: r for r in trie.token_counts(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA), path).collect()}
    assert [got[i].n_pretokens for i in range(7)] == [0, 0, 0, 2, 2, 2, 1]
    assert got[3].n_tokens == got[4].n_tokens >= 2 and got[3].score == got[4].score and got[6].n_tokens > 100
    assert trie.token_counts(spark.createDataFrame([], SCHEMA), path).collect() == []


# ---- licences


def test_licences(spark):
    *_, threshold, right = licences.model()
    assert right >= 0.95 and 0.05 < threshold < 0.95  # found inside the range that is scanned
    lines = {
        "Released under the MIT License.": "mit",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
        "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
        "All rights reserved.": "proprietary",
        "The committee gave its permission to go on.": None,
        "He was licensed to drive, and reserved a table.": None,
        "nothing here": None,
    }
    rows = [(i, f"first line\n{t}\nlast", "en", "s") for i, t in enumerate(lines)] + [(50, None, None, None), (51, "", None, None), (52, "\n".join(list(lines)[:2]), None, None)]
    got = {r.doc_id: r for r in licences.licence_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, family in enumerate(lines.values()):
        assert got[i].families == (family or "")
    assert got[50].n_paragraphs == 0 and got[51].n_paragraphs == 0 and got[52].families == "apache-2.0,mit" and got[52].n_confirmed == 2
    assert licences.licence_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sibling_licences(spark):
    """Licences that differ in a word or number from another are told apart; unknown ones are nobody's."""
    lines = {
        "Licensed under CC BY 4.0.": "cc-by-4.0",
        "Licensed under CC BY-SA 4.0.": "cc-by-sa-4.0",
        "Licensed under CC BY-ND 4.0.": "cc-by-nd-4.0",
        "Licensed under CC BY-NC-SA 4.0.": "cc-by-nc-sa-4.0",
        "Licensed under CC BY 3.0.": "",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "cc-by-sa-4.0",
        "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.": "lgpl-2.1",
        "This work is licensed under the GNU Affero General Public License, version 3.": "agpl-3.0",
        "Licensed under the Mozilla Public License, version 2.0.": "mpl-2.0",
        "Released under the ISC License.": "isc",
        "SPDX-License-Identifier: GPL-2.0-only": "gpl-2.0",
    }
    rows = [(i, t, "en", "s") for i, t in enumerate(lines)]
    got = {r.doc_id: r.families for r in licences.licence_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {t: got[i] for i, t in enumerate(lines)} == lines


def brute_licences(rows):
    """{row: (paragraphs, claimed, confirmed, families)} by the rules, one document after another."""
    families, vocab, w, b, threshold, _ = licences.model()
    place = {g: i for i, g in enumerate(vocab)}

    def judge(text):
        text = re.sub(r"[.!?]+(?=\s|$)", " § ", text) + " §"
        tokens = [x for x in (y.strip("./+-") for y in re.split(r"[^a-z0-9./+§-]+", text)) if x]
        found = licences.grams(tokens) & set(place)
        z = np.exp(sum((w[place[g]] for g in found), np.zeros(len(families))) + b)
        best = max(zip((z / z.sum()).tolist(), families))
        if not found or best[1] == licences.NEGATIVE or best[0] < threshold:
            return None
        near = []
        for family, of in [*licences.TEMPLATES.items(), ("", licences.UNKNOWN)]:
            for template in of:
                ws = [x.strip("./+-") for x in licences.words(template)]
                all_ = licences.grams(ws)
                if (not family or set(licences.telling(ws)) <= found) and len(all_ & found) >= licences.CONFIRM * len(all_):
                    near.append((len(all_ & found), -len(all_), family))
        return best[1], bool(near) and max(near)[2] == best[1]

    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, set()).add(text or "")
    claims = {}
    for doc, all_ in texts.items():
        assert len(all_) == 1
        for part in re.split(licences.BREAK, next(iter(all_)).lower()):
            lines = [x for x in map(judge, filter(lambda line: line.strip(" "), part.split("\n"))) if x]
            told = [x for x in lines if x[1]]
            whole = judge(part) if "\n" in part else None
            beside = [whole] if whole and whole[1] and whole[0] not in {f for f, _ in told} else []
            claims.setdefault(doc, []).extend(told + beside if told else [whole] if whole else lines)
    out = []
    for doc, text in rows:
        c = claims.get(doc, [])
        if any(ok and f != "proprietary" for f, ok in c):
            c = [x for x in c if x[0] != "proprietary"]
        if any(ok and re.match("[al]?gpl-", f) for f, ok in c):
            c = [x for x in c if x[0] != "gpl"]
        n = len(re.split(licences.BREAK, text)) if text else 0
        out.append((-1 if doc is None else doc, n, len(c), sum(x[1] for x in c), ",".join(sorted({f for f, ok in c if ok}))))
    return sorted(out)


def test_licences_equal_brute_force(spark):
    """Wrapped notices, repeated rows, null ids, very long lines, extra columns, other languages."""
    rng = random.Random(14)
    notices = [t for ts in licences.TEMPLATES.values() for t in ts] + licences.UNKNOWN
    rows = []
    for i, t in enumerate(notices):
        ws = t.split()
        at = rng.randint(1, len(ws) - 1) if len(ws) > 1 else 1
        wrapped = " ".join(ws[:at]) + "\n" + " ".join(ws[at:])
        rows.append((i, rng.choice([f"{words(rng, 9)}.\n{t.title()}.\n{words(rng, 5)}", f"{words(rng, 4)}\n\n{wrapped}\n \nend", wrapped, f"{t} {t}. {words(rng, 30)}", f"He gave permission: {t}\nlicence {words(rng, 3)}"])))
    rows += [(500, "released under the mit license"), (500, "released under the mit license"), (None, "all rights reserved"), (None, "all rights reserved"), (501, None), (502, ""), (503, "x " * 40_000 + "released under the mit license " + "y " * 40_000), (504, "\n\n\n"), (505, "Lizenz: licenÇe ©")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, paragraph int, family string").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_paragraphs, r.n_claimed, r.n_confirmed, r.families) for r in licences.licence_report(df).collect())
    assert got == brute_licences(rows)


def test_licences_without_a_usual_anchor(spark):
    """No text can reach the threshold without an anchor; notices without the word licence, or with words left out, are found."""
    words_, reach = licences.anchors()
    assert reach < licences.model()[4] and len(words_) < 200
    texts = {
        "This photo is shared under CC BY-NC-SA 4.0.": "cc-by-nc-sa-4.0",
        "This source code form is subject to the terms of the Mozilla Public v 2.0.": "mpl-2.0",
        "Use in source and binary forms, with or without modification, are permitted.": "bsd",
        "Released under the MIT License\nand this program is licensed under the Apache\nLicense Version 2.0 the License you may not\nuse this file except in compliance with the License": "apache-2.0,mit",
    }
    got = {r.doc_id: r.families for r in licences.licence_report(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_licences_of_no_family_are_unknown(spark):
    """Notices that neither the fit nor the calibration saw."""
    rows = [(i, t, None, None) for i, t in enumerate(licences.UNKNOWN[1::2])]
    assert all(r.n_confirmed == 0 for r in licences.licence_report(spark.createDataFrame(rows, SCHEMA)).collect())
    wrapped = "Permission is hereby granted, free of charge,\nto any person obtaining a copy\nof this software and associated files"
    got = licences.licence_report(spark.createDataFrame([(1, f"Some words.\n{wrapped}\n\nCode", None, None)], SCHEMA)).first()
    assert got.families == "mit" and got.n_confirmed == 1


BSD = """Copyright (c) 2019, The Regents. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
GNU = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version."""
PROBES = {
    BSD: "bsd",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software": "",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction": "mit",
    GNU.format("", "3"): "gpl-3.0",
    GNU.format("", "2"): "gpl-2.0",
    GNU.format("Lesser ", "2.1"): "lgpl-2.1",
    GNU.format("Lesser ", "3"): "lgpl-3.0",
    GNU.format("Affero ", "3"): "agpl-3.0",
    "The museum said all rights reserved seats were sold out": "",
    "Copyright 2011 Acme Inc. All rights reserved.": "proprietary",
    "MIT License": "mit",
    "The MIT License (MIT)": "mit",
    "Apache License 2.0": "apache-2.0",
    "License: Apache-2.0": "apache-2.0",
    "Licensed under GPLv3.": "gpl-3.0",
    "GNU General Public License v3.0": "gpl-3.0",
    "GNU General Public License v2.0": "gpl-2.0",
    "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved.": "gpl-3.0",
    "Licensed under the Boost Software License, Version 1.0.": "",
    "This is free and unencumbered software released into the public domain.": "",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0.": "",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted, provided that the above copyright notice appear in all copies": "",
    "He studied at MIT and had a driving license for cars.": "",
    "Permission is hereby granted to the club to use the hall free of charge.": "",
    "You may not use this file except in compliance with the License.": "",
}


def test_no_wrong_licence_is_confirmed(spark):
    rows = [(i, f"Some words before it.\n\n{t}\n\nand after it", "en", "s") for i, t in enumerate(PROBES)]
    got = {r.doc_id: r.families for r in licences.licence_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {t: got[i] for i, t in enumerate(PROBES)} == PROBES


def test_licences_compile(spark):
    """The code that Spark generates compiles: where it did not, the driver kept it, its errors and its log by the hundred MB."""
    spark.conf.set("spark.sql.codegen.fallback", "false")  # an error, not slower rows
    try:
        got = licences.licence_report(spark.createDataFrame([(1, "Released under the MIT license.", None, None)], SCHEMA)).first()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert got.families == "mit"
