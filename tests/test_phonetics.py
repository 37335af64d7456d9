"""Scalar goldens and operators on small frames."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cadenza.api import Api, handle_line
from cadenza.engine import Engine
from cadenza.functions import columns
from cadenza.functions import phonemes as ph
from cadenza.functions import syllables
from cadenza.functions import text as tx
from cadenza.operators import prosody
from cadenza.sources import lexicon as lx


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark)


def words(spark, *w):
    return spark.createDataFrame([(x,) for x in w], "word string")


def test_codec():
    assert ph.encode("AA0") == "A" and ph.encode("AA1") == "a" and ph.encode("UW2") == "~"
    assert ph.encode("B") == "(" and ph.encode("ZH") == "?"
    for bad in ("", "GARBAGE", "XX", "A", "B0"):
        assert ph.encode(bad) == ph.INVALID and not ph.is_valid(bad)
    assert ph.is_valid_base("B0") and ph.encode("CH1") == ph.encode("CH") and ph.encode("AA") == "A" and ph.encode("AA7") == "A"
    assert all(ph.encode(n) == c for c, n in ph.NAMES.items()) and len(ph.NAMES) == 69
    assert ph.decode("!") == ""
    assert all((a, b, d) in set(ph.vowel_distances()) and (b, a, d) in set(ph.vowel_distances()) for a, b, d in ph.vowel_distances())


def test_columns(spark):
    names = ["AA0", "AA1", "UW2", "B", "ZH", "CH1", "AA", "AA7", "", "GARBAGE", "XX", "A", "B0", "IH2"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    got = frame.select("n", columns.encode("n").alias("c"), columns.is_valid("n").alias("v"), columns.is_valid_base("n").alias("b")).collect()
    assert [(r.c, r.v, r.b) for r in got] == [(ph.encode(n), ph.is_valid(n), ph.is_valid_base(n)) for n in names]
    assert "phoneme_tail" in columns.register(spark)
    cat = ph.encode_all(["K", "AE1", "T"])
    r = spark.sql(f"SELECT phoneme_decode('{cat}') d, phoneme_tail('{cat}') t, phoneme_syllables('{cat}') n, phoneme_encode('AE1') e, syllable_display('hello', '01') s").first()
    assert (r.d, r.t, r.n, r.e, r.s) == ("K AE1 T", ph.encode_all(["AE", "T"]), 1, "b", "hel-LO")


def test_lexicon_tables(spark, engine, tmp_path):
    (tmp_path / "a.dict").write_text("cat  K AE1 T\ncat(1)  K AH0 T\n;;; x\nbat  B AE1 T\n")
    loaded = lx.load(spark, str(tmp_path / "a.dict"))
    e = Engine(spark, loaded)
    assert sorted(r.word for r in e.keys().collect()) == ["BAT", "CAT"]
    assert e.counts() == {"words": 2, "groups": 1, "codas": 1, "neighbors": 0}
    assert engine.counts()["words"] == engine.entry_count()


def test_lexicon_parse():
    rows = lx.parse(["", ";;; note", "word  W ER1 D", "word(1)  W ER0 D", "alone", "Éa B # aside", "two W"])
    assert rows == [("WORD", 0, ph.encode_all(["W", "ER1", "D"])), ("WORD", 1, ph.encode_all(["W", "ER0", "D"])), ("ÉA", 0, "("), ("TWO", 0, ph.encode("W"))]
    assert not [w for w, _, p in lx.seed() if ph.INVALID in p]


def test_text(spark):
    cases = {"don't": "DON'T", "well-known": "WELL-KNOWN", "(test)": "TEST", "runnin'": "RUNNING", "straße": "STRASSE"[:4] + "SE", "in'": "IN'", "": "", "'": "'", "RunnIN'": "RUNNING"}
    cases["straße"] = "STRASE"
    df = words(spark, *cases).select("word", tx.normalize(F.col("word")).alias("n"))
    assert {r.word: r.n for r in df.collect()} == cases
    line = "well-known runnin' don't stop' 'tis - in' a" + "b" * 3000
    got = spark.createDataFrame([(line,)], "t string").select(*(tx.tokens(F.col("t"), k).alias(k) for k in "wsm")).first()
    tail = "a" + "b" * 3000
    assert got.s == ["well", "known", "runnin'", "don't", "stop", "tis", "in", tail]
    assert got.m == ["well-known", "runnin'", "don't", "stop", "tis", "in", tail]
    assert got.w == ["well-known", "runnin'", "don't", "stop'", "'tis", "-", "in'", tail]


def test_syllable_split():
    assert syllables.split("hello", 2) == ["hel", "lo"] and syllables.split("summer", 2) == ["sum", "mer"] and syllables.split("cat", 0) == ["cat"]
    assert syllables.display("hello", "01") == "hel-LO" and syllables.display("summer", "10") == "SUM-mer" and syllables.split("", 3) == [""]
    assert syllables._runs("make") == [[1, 2]] and syllables._runs("rhythms") == [[2, 3]] and syllables._runs("brrr") == [[0, 4]]


def tree(a: str, b: str):
    """The decision tree of rhyme types, one pair at a time."""

    def lev(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, e in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
            row = new
        return row[-1]

    def at(p, chars):
        k = max((i for i, c in enumerate(p) if c in chars), default=-1)
        return p[k:] if k >= 0 else ""

    def strip(p):
        return p.translate(str.maketrans(ph.PRIMARY + ph.SECONDARY, ph.PLAIN * 2))

    def sim(x, y):
        return 1.0 if not x and not y else 1 - lev(x, y) / max(len(x), len(y))

    r4 = lambda v: int(v * 10000 + 0.5) / 10000
    every = ph.PLAIN + ph.PRIMARY + ph.SECONDARY
    ta, tb = (at(p, ph.PRIMARY) or at(p, ph.SECONDARY) or at(p, every) for p in (a, b))
    weak = not any(c in ph.PRIMARY + ph.SECONDARY for c in a + b)
    if not ta or not tb:
        return "none", 0.0
    ta, tb = strip(ta), strip(tb)
    ends = lambda x, y: len(x) != len(y) and min(x, y, key=len)[:1] in set(ph.PLAIN) and max(x, y, key=len).endswith(min(x, y, key=len))
    if ends(ta, tb):
        n = min(len(ta), len(tb))
        kind, conf = ("identity", 1.0) if a[: len(a) - n] == b[: len(b) - n] else ("perfect", 0.95)
        return ("near" if weak and kind == "perfect" else kind), r4(conf * 0.5 if weak else conf)
    s = sim(ta, tb)
    tails = len(ta) >= 3 and len(tb) >= 3 and ta[1:] == tb[1:]
    if ta == tb:
        kind, conf = ("identity" if a[: len(a) - len(ta)] == b[: len(b) - len(tb)] else "perfect"), s
    elif ta[0] == tb[0] and s >= 0.5:
        kind, conf = "near", s
    elif tails and s >= 0.3:
        kind, conf = "slant", s * 0.8
    elif s >= 0.4:
        kind, conf = "near", s * 0.7
    else:
        kind, conf = "none", s * 0.3
    if kind == "none" or conf < 0.5:
        ea, eb = strip(at(a, every)), strip(at(b, every))
        es = sim(ea, eb)
        etails = len(ea) >= 3 and len(eb) >= 3 and ea[1:] == eb[1:]
        end = None
        if ea == eb:
            end = ("identity", 0.85) if a[: len(a) - len(ea)] == b[: len(b) - len(eb)] else ("near", 0.8)
        elif ends(ea, eb):
            end = "near", 0.75
        elif ea[0] == eb[0] and es >= 0.6:
            end = "near", es * 0.75
        elif etails and es >= 0.5:
            end = "slant", es * 0.65
        if end:
            c = r4(end[1] * 0.5 if weak else end[1])
            if c > conf:
                return end[0], c
    if weak and kind != "none":
        kind, conf = ("near" if kind == "perfect" else kind), conf * 0.5
    return kind, r4(min(max(conf, 0), 1))


def test_rhyme_tree(spark, engine):
    rng = random.Random(5)
    some = "(*,/36:" + "ABIabiqr"
    pairs = [("".join(rng.choices(some, k=rng.randint(0, 6))), "".join(rng.choices(some, k=rng.randint(0, 6)))) for _ in range(3000)]
    for _ in range(1500):
        end = "".join(rng.choices("(*,/36:A", k=rng.randint(1, 4)))
        pairs.append(tuple("".join(rng.choices(some, k=rng.randint(0, 3))) + rng.choice("ABIabiqr") + end for _ in range(2)))
    got = engine.analyze(spark.createDataFrame(pairs, "a string, b string")).collect()
    assert {r.rhyme_type for r in got} == {"none", "identity", "perfect", "near", "slant"}
    for r in got:
        assert (r.rhyme_type, r.confidence) == tree(r.a, r.b), (r.a, r.b)


def test_lookup_and_counts(spark, engine):
    got = {r.word: r for r in engine.lookup(words(spark, "cat", "hello", "Beautiful", "runnin'", "xyzzyplugh")).collect()}
    assert set(got) == {"CAT", "HELLO", "BEAUTIFUL", "RUNNING"}
    assert got["CAT"].syllable_count == 1 and got["HELLO"].stress_pattern == [0, 1] and got["BEAUTIFUL"].syllable_count == 3
    assert got["RUNNING"].phonemes[-2:] == ["AH0", "N"] and got["HELLO"].stress_display == "hel-LO"
    lines = spark.createDataFrame([(0, "the cat - brr"), (1, ""), (2, None)], "i int, text string")
    counts = {r.i: (r.total, [tuple(w) for w in r.words]) for r in engine.syllable_counts(lines, ["i"]).collect()}
    assert counts == {0: (4, [("the", 1), ("cat", 1), ("-", 1), ("brr", 1)]), 1: (0, []), 2: (0, [])}


def test_rhymes(spark, engine):
    cat = [r.match for r in engine.perfect_rhymes(words(spark, "cat")).orderBy("pos").collect()]
    assert cat == sorted(cat) and {"BAT", "HAT", "MAT", "SAT"} <= set(cat) and "CAT" not in cat
    slant = {r.match: r.confidence for r in engine.slant_rhymes(words(spark, "love"), 50).collect()}
    assert slant["MOVE"] == 0.6 and "DOVE" not in slant
    near = {r.match for r in engine.near_rhymes(words(spark, "see"), 200).collect()}
    assert {"SEA"}.isdisjoint(near) and "EAT" in near
    for limit in (0, 3, 9999):
        got = engine.rhymes(words(spark, "night", "love", "xyzzyplugh"), limit).collect()
        for w in ("night", "love"):
            mine = sorted((r.pos, r.match, r.rhyme_type) for r in got if r.word == w)
            assert len(mine) <= min(limit, 500) and len({m for _, m, _ in mine}) == len(mine)
            order = [{"perfect": 0, "slant": 1, "near": 2}[k] for _, _, k in mine]
            assert order == sorted(order) and [p for p, _, _ in mine] == list(range(1, len(mine) + 1))
    custom = engine.with_custom_words(spark.createDataFrame([("zcat", ["K", "AE1", "T"])], "word string, phonemes array<string>"))
    assert "ZCAT" in {r.match for r in custom.perfect_rhymes(words(spark, "cat")).collect()}


def word_no(i):
    return "W" + "".join(chr(65 + i // 26**k % 26) for k in range(3, -1, -1))


def synthetic(n, seed=5, codas=40):
    """A lexicon of ``n`` words: random onsets, primary vowels and few codas, some with a second pronunciation."""
    rng = random.Random(seed)
    ends = ["", "", *("".join(ph.CODES[c] for c in rng.choices(ph.CONSONANTS[:8], k=rng.randint(1, 4))) for _ in range(codas))]
    rows = []
    for i in range(n):
        for variant in range(1 + (i % 7 == 0)):
            onset = "".join(ph.CODES[c] for c in rng.choices(ph.CONSONANTS, k=rng.randint(1, 3)))
            rows.append((word_no(i), variant, onset + rng.choice(ph.PRIMARY) + rng.choice(ends)))
    return rows


def searched(rows, query, k):
    """Slant and near matches of one word by going over the whole lexicon: [(match, confidence)], [match]."""
    far = {(a, b): d for a, b, d in ph.vowel_distances()}
    tails = [(w, v, p[next(i for i, c in enumerate(p) if c in ph.PRIMARY) :].translate(str.maketrans(ph.PRIMARY, ph.PLAIN))) for w, v, p in rows]
    slant, near = [], []
    for _, v, t in (x for x in tails if x[0] == query):
        nucleus, coda = t[0], t[1:]
        met, close = {}, {}
        for w, _, u in tails:
            if w == query:
                continue
            d, end = far[nucleus, u[0]], u[1:]
            if end == coda and u[0] != nucleus:
                rank = (0, "", 0, d, u[0])
            elif len(coda) >= 2 and len(end) > len(coda) and end.endswith(coda):
                rank = (1, end, len(end) - len(coda), 5 if u[0] == nucleus else d, u[0])
            elif len(end) >= 2 and len(coda) > len(end) and coda.endswith(end):
                rank = (2, "", len(coda) - len(end), 5 if u[0] == nucleus else d, u[0])
            else:
                rank = None
            if rank and rank[3] <= 50:
                met[w] = min(met.get(w, rank), rank)
            short, long = sorted((coda, end), key=len)
            one = len(short) == len(long) and sum(a != b for a, b in zip(short, long)) == 1 or len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))
            if u[0] == nucleus and one and max(len(coda), len(end)) <= 3:
                close[w] = min(close.get(w, end), end)
        kept = sorted((r, w) for w, r in met.items())[:k]
        slant.append((-len(kept), v, kept))
        first = sorted((e, w) for w, e in close.items())[: max(4 * k, 200)]
        near.append((-len(first), v, [(abs(len(e) - len(coda)), w) for e, w in first]))
    conf = lambda r: round((1 - r[3] / 100 if r[0] == 0 else max(1 - r[3] / 100 - 0.06 * r[2], 0.15)) * 10000) / 10000
    found = sorted(((conf(r), w) for r, w in min(slant)[2]), key=lambda x: (-x[0], x[1]))
    return [(w, c) for c, w in found], [w for _, w in sorted(min(near)[2])[:k]]


@pytest.mark.parametrize("n, k", [(2_000, 5), (2_000, 60), (60, 20)])
def test_searches_against_whole_lexicon(spark, n, k):
    rows = synthetic(n)
    e = Engine(spark, spark.createDataFrame(rows, "word string, variant int, pron string"))
    asked = [word_no(i) for i in range(0, 56, 5)]
    q = words(spark, *asked)
    slant, near = e.slant_rhymes(q, k).collect(), e.near_rhymes(q, k).collect()
    for w in asked:
        a, b = searched(rows, w, k)
        assert [(r.match, r.confidence) for r in sorted((r for r in slant if r.word == w), key=lambda r: r.pos)] == a
        assert [r.match for r in sorted((r for r in near if r.word == w), key=lambda r: r.pos)] == b


def test_searches_in_a_large_lexicon(spark):
    rows = synthetic(100_000, codas=3_000)
    e = Engine(spark, spark.createDataFrame(rows, "word string, variant int, pron string"))
    got = e.rhymes(words(spark, *(word_no(i) for i in range(0, 100_000, 1_000))), 20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    per = {}
    for r in got.collect():
        per.setdefault(r.word, []).append(r.pos)
    assert len(per) == 100 and all(sorted(p) == list(range(1, len(p) + 1)) and len(p) <= 20 for p in per.values())


def test_compare(spark, engine):
    p = spark.createDataFrame([("cat", "bat"), ("cat", "elephant"), ("cat", "xyzzyplugh"), ("night", "nice"), ("cat", "cat")], "word1 string, word2 string")
    got = {(r.word1, r.word2): r for r in engine.compare(p).collect()}
    assert got["cat", "bat"].rhyme_type == "perfect" and got["cat", "bat"].similarity == 0.6667
    assert ("cat", "xyzzyplugh") not in got and got["night", "nice"].rhyme_type == "near" and got["cat", "cat"].similarity == 1.0
    assert got["cat", "cat"].rhyme_type == "perfect"


def test_meter(spark):
    bits = ["01" * 5, "10" * 4, "001" * 3, "", "1", "0101110101"]
    got = {r.bits: r for r in prosody.metered(spark.createDataFrame([(b,) for b in bits], "bits string")).collect()}
    assert (got["01" * 5].meter_name, got["01" * 5].regularity) == ("iambic pentameter", 1.0)
    assert got["10" * 4].meter_name == "trochaic tetrameter" and got["001" * 3].meter_name == "anapestic trimeter"
    assert got[""].meter_name == "none" and (got["1"].meter_name, got["1"].foot_count, got["1"].regularity) == ("iamb", 0, 0.0)
    dev = spark.createDataFrame([("0101110101",)], "b string").select(prosody.deviations("b", "'01'").alias("d")).first().d
    assert [(x.position, x.expected, x.actual) for x in dev] == [(4, "unstressed", "stressed")]
    pair = spark.createDataFrame([("0101", "iamb", 2, "1010", "trochee", 2), ("0101", "iamb", 2, "010101", "iamb", 3), ("", "none", 0, "", "none", 0)], "bits1 string, foot_type1 string, foot_count1 int, bits2 string, foot_type2 string, foot_count2 int")
    a, b, c = prosody.compared_meter(pair).collect()
    assert (a.same_meter, a.stress_agreement, a.mismatch_positions) == (False, 0.0, [0, 1, 2, 3])
    assert b.mismatch_positions == [4, 5] and b.stress_agreement == 0.6667 and c.stress_agreement == 1.0


def test_meter_of_any_length(spark):
    rng = random.Random(2)
    bits = [format(rng.getrandbits(n + 1) | 1 << n, "b")[1:] for n in [*range(1, 70), 119, 120, 121, 180, 181, 400]]
    got = {r.bits: r for r in prosody.metered(spark.createDataFrame([(b,) for b in bits], "bits string")).collect()}
    feet = {"iamb": "01", "trochee": "10", "anapest": "001", "dactyl": "100", "spondee": "11", "pyrrhic": "00"}
    for b in bits:
        scores = {}
        for name, f in feet.items():
            agree, over = sum(c == f[i % len(f)] for i, c in enumerate(b)), len(b) % len(f)
            raw = agree / len(b) * (1 - 0.05 * over / len(f) if over else 1.0)
            scores[name] = 0.0 if len(b) < len(f) else int(raw * 10000 + 0.5) / 10000
        best = max(scores, key=scores.get)  # the first among equals
        assert (got[b].foot_type, got[b].regularity, got[b].foot_count) == (best, scores[best], len(b) // len(feet[best]))


def test_scan_and_document(spark, engine):
    api = Api(engine)
    s = api.scan("uneasy lies the head that wears the crown", "")
    assert s["line1"]["syllableCount"] == 10 and s["line1"]["visual"] == "x / x / x / x / x /" and s["line1"]["meter"]["name"] == "iambic pentameter" and s["comparison"] is None
    lines = spark.createDataFrame([("shall I compare thee to a summer's day",)], "text string").withColumn("i", F.lit(0))
    spoken, strict = (engine.scan(lines, ["i"], m).first().stresses for m in ("spoken", "dictionary"))
    assert spoken[0] == "0" and strict[0] == "1"
    doc = api.document(["the cat sat on the mat", "", "the bat sat on the hat"], include_rhyme_map=True)
    assert doc["summary"]["lineCount"] == 3 and doc["summary"]["nonEmptyLineCount"] == 2 and doc["summary"]["dictionaryCoverage"] == 1.0
    assert any(p["ngram"] == "AE0-T" for p in doc["rhymeMap"]["patterns"]) and len(doc["lines"]) == 3
    assert api.document([])["summary"]["dictionaryCoverage"] == 1.0 and "rhymeMap" not in api.document(["a"])


def test_rpc(engine):
    api = Api(engine)
    call = lambda name, **args: json.loads(handle_line(api, json.dumps({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": args}})))["result"]
    assert json.loads(call("lookup", word="cat")["content"][0]["text"])["word"] == "CAT"
    assert call("lookup", word="xyzzyplugh")["isError"] and call("nothing")["isError"] and call("analyze_document", lines=["x"] * 101)["isError"]
    assert json.loads(handle_line(api, "{"))["error"]["code"] == -32700
    assert json.loads(handle_line(api, '{"id": 2, "method": "nope"}'))["error"]["code"] == -32601 and handle_line(api, '{"method": "notifications/initialized"}') is None
    assert len(json.loads(handle_line(api, '{"id": 3, "method": "tools/list"}'))["result"]["tools"]) == 5
    assert len(json.loads(call("rhymes", word="cat", limit=3)["content"][0]["text"])) == 3 and call("rhymes")["isError"] and call("lookup", word=3)["isError"]
    long = json.loads(call("analyze_document", lines=["cat " * 300])["content"][0]["text"])
    assert long["summary"]["totalWordTokens"] == 300
    assert "line1" not in json.loads(call("scan", line="the cat")["content"][0]["text"])


def test_http(engine):
    import threading
    import urllib.error
    import urllib.request

    from cadenza import serve

    api = Api(engine)
    get = lambda path: serve.respond(api, "GET", path)
    post = lambda path, value: serve.respond(api, "POST", path, json.dumps(value).encode())
    status, cat = get("/rhymes?word=cat&limit=5")
    assert status == 200 and set(cat) == {"word", "phonemes", "syllables", "matches"} and len(cat["matches"]) == 5 and cat["syllables"] == 1
    assert [get(p)[0] for p in ("/syllables", "/syllables?word=", "/syllables?word=xyzzyplugh", "/rhymes?word=cat&limit=x", "/nope", "/rhymemap", "/compare?word1=cat")] == [400, 400, 404, 400, 404, 405, 400]
    assert get("/syllables?word=cat")[1]["word"] == "CAT" and get("/compare?word1=cat&word2=bat")[1]["rhymeType"] == "perfect"
    assert get("/scan?line1=the%20cat")[1]["line2"] is None and all(get(f"/rhymes/{k}?word=cat")[0] == 200 for k in ("perfect", "slant", "near"))
    assert [x["total"] for x in post("/syllable-counts", {"lines": ["the cat", ""]})[1]["lines"]] == [2, 0]
    assert post("/document", {"lines": ["cat " * 300]})[1]["summary"]["totalWordTokens"] == 125  # 500 bytes of the line
    assert post("/rhymemap", {"lines": []})[0] == 400 and post("/rhymemap", {"lines": ["cat hat"]})[0] == 200 and post("/document", {})[0] == 400
    assert serve.respond(api, "POST", "/document", b"x" * 70_000)[0] == 413 and serve.respond(api, "POST", "/document", b"[")[0] == 400
    with serve.server(api, port=0) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        at = f"http://127.0.0.1:{s.server_address[1]}"
        assert json.loads(urllib.request.urlopen(f"{at}/health").read())["status"] == "ok"
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(f"{at}/syllables")
        s.shutdown()
