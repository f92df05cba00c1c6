import hashlib
import random
import re
import string

from inkwell.llm.secrets import scan_secrets

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(4)
    bits = ["password", "Passwd: ", "SECRET=", "token", "api_key ='", "apikey", ":", "=", " ", '"', "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef" * 2, "deadbeef", "é", "𠀀", "a.b-c_d/e", "word", "\n", "password: token: abcdefgh1"]
    texts = [None, "", *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(300)), "x " * 60_000 + "token=abcdefgh"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in scan_secrets(df).collect():
        want = base(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[2] == k for s in want) for k in ("assign", "access", "hex")]
        kept = [s for s in r.spans.split(",") if s and not s.startswith("random")]
        assert ",".join(kept) == listed(want)


def test_battery_adds_random_runs_and_leaves_words(spark):
    rng = random.Random(9)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(50)]
    names = [f"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa{i:04d}" for i in range(50)]
    df = spark.createDataFrame([(i, f"see {k} here") for i, k in enumerate(keys + names)], "doc_id long, text string")
    out = {r.doc_id: r.n_random for r in scan_secrets(df).collect()}
    assert sum(out[i] for i in range(50)) >= 45 and sum(out[i] for i in range(50, 100)) == 0
    words = spark.createDataFrame([(1, "The quick internationalizationofeverything jumps")], "doc_id long, text string")
    assert scan_secrets(words).first().spans == ""
    assert scan_secrets(words.limit(0)).collect() == []


def test_very_long_runs_and_many_matches(spark):
    rng = random.Random(3)
    letters = string.ascii_letters + string.digits
    run = "".join(rng.choice(letters) for _ in range(1_000_000))
    many = " ".join(f"token={'x' * 7}{rng.choice('ab')} é Zq{i:030d}9Az" for i in range(20_000))
    df = spark.createDataFrame([(1, "data " + run + " end"), (2, many), (2, many), (None, "token=abcdefgh")], "doc_id long, text string")
    out = scan_secrets(df).collect()
    assert len(out) == 4
    for r in out:
        if r.doc_id == 1:
            assert r.spans == "random:5:1000005"
        elif r.doc_id == 2:
            assert r.n_assign == 20_000 and r.base_sha256 == hashlib.sha256(listed(base(many)).encode()).hexdigest()
        else:
            assert r.spans == "assign:0:14"


def test_runs_that_touch_base_spans_are_not_added(spark):
    rng = random.Random(5)
    key = lambda n: "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n))
    texts = [" ".join(rng.choice((f"token={key(30)}", key(40), "AKIA" + "A1B2C3D4E5F6", f"x{'0123456789abcdef' * 2}Z", "word", f"token=abc.{key(40)}")) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan_secrets(df, fdr=0.0).collect():  # nothing is rejected
        spans = [s.split(":") for s in r.spans.split(",") if s]
        got = {(int(a), int(b)) for k, a, b in spans if k == "random"}
        runs = {m.span() for m in re.finditer(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}", texts[r.doc_id])}
        assert got == {(a, b) for a, b in runs if not any(s < b and a < e for s, _, _, e in base(texts[r.doc_id]))}


def test_identifiers_are_no_keys(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("user account session request handler internal message buffer config value index table column record".split())
    names = ["-".join(word() for _ in range(7)) + f"-{rng.randrange(100)}" for _ in range(200)]
    names += ["".join(word().title() for _ in range(7)) + f"V{rng.randrange(10)}" for _ in range(200)] + ["/".join(word() for _ in range(8)) + f"/{rng.randrange(2000)}" for _ in range(200)]
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(64)) for _ in range(200)]
    df = spark.createDataFrame([(i, f"see {k} here") for i, k in enumerate(keys + names)], "doc_id long, text string")
    out = {r.doc_id: r.n_random for r in scan_secrets(df).collect()}
    assert sum(out[i] for i in range(200)) >= 185
    assert sum(out[i] for i in range(200, 800)) <= 30
