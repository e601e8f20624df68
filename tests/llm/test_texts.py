"""Secrets, quality rules, line dedup, quotations and decontamination against plain Python."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from hopweave.llm import decontaminate, lines, quotes, rules, secrets


def test_known_secrets():
    text = "x token : \"abc\" Secret=abcdef AKIA" + "A" * 16 + " " + "a" * 60 + " 0123456789abcdef0123456789 api_key='zzzzzz' PASSWD=12345 ſecret=abcdefg"
    spans = secrets.known_spans(text)
    assert [(k, text[s:e]) for k, s, e in spans] == [("assign", "Secret=abcdef"), ("assign", "api_key='zzzzzz"), ("access", "AKIA" + "A" * 16), ("hex", "a" * 60), ("hex", "0123456789abcdef0123456789")]
    assert secrets.known_spans("token: token : abcdefgh") == []  # the first match takes "token: token" and is dropped


def test_entropy_by_counts():
    rng = random.Random(2)
    import math

    for _ in range(300):
        run = "".join(rng.choice("abcdefghijkl0123") for _ in range(rng.randrange(20, 80)))
        h = [-sum(c / 20 * math.log2(c / 20) for c in Counter(run[i : i + 20]).values()) for i in range(len(run) - 19)]
        above = [i for i, x in enumerate(h) if x > 3.4 + 1e-9]
        assert secrets.entropy_stretch(run, 3.4) == ((above[0], above[-1] + 20) if above else None) or any(abs(x - 3.4) < 1e-9 for x in h)


def test_entropy_and_allow_list():
    scan = secrets.make_scanner()
    blob = "aGVsbG8gd29ybGQgMTIzNDU2Nzg5MEFCQ0RFRg"
    assert [k for k, _, _ in scan(f"see {blob} now")] == ["entropy"]
    for quiet in ("123e4567-e89b-12d3-a456-426614174000", "a/long/path/with/many/parts/in/it", "SAMPLE" + "a" * 30, "x" * 50000, "EXAMPLE" + blob):
        assert [x for x in scan(f"see {quiet} now") if x[0] == "entropy"] == []
    assert scan("") == []


def test_secrets_beside_known_forms():
    scan = secrets.make_scanner()
    key, commit = "kX9vQ2mZ7pL4tR8wB3nJ6yH1cF5dS0gAeUiOqTzM", "0123456789abcdef01234567"
    text = f"see path/{commit}/{key} and {key}/{commit}-x"
    found = scan(text)
    assert [text[s:e] for k, s, e in found if k == "hex"] == [commit] * 2
    assert len([1 for k, s, e in found if k == "entropy" and key in text[s:e]]) == 2
    assert all(commit not in text[s:e] for k, s, e in found if k == "entropy")


def test_recall_on_random_keys():
    rng, scan = random.Random(8), secrets.make_scanner()
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for letters in (lower + "0123456789", upper + "234567", lower + upper + "0123456789", lower + upper + "0123456789+/"):
        for size in (20, 24, 32, 40):
            keys = ["".join(rng.choice(letters) for _ in range(size)) for _ in range(500)]
            missed = sum(not any(k == "entropy" for k, _, _ in scan(f"a {key} b")) for key in keys)
            assert missed <= 35, (letters, size, missed)


def slow_spans(text):
    """Every span, by the definitions: each window's entropy is computed afresh."""
    import math

    found = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A | re.I) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    inside = {i for _, s, e in found for i in range(s, e)}
    token = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
    w = secrets.WINDOW

    def runs(chars, text, skip=()):
        at = 0
        while at < len(text):
            end = at
            while end < len(text) and text[end] in chars and end not in skip:
                end += 1
            if end - at >= w:
                yield at, end
            at = max(end, at + 1)

    def bits(run):
        lower, upper, digit = any(c.islower() for c in run), any(c.isupper() for c in run), any(c.isdigit() for c in run)
        if set(run) <= set("0123456789abcdef") or set(run) <= set("0123456789ABCDEF"):
            return secrets.HEX_BITS
        if run.isalnum() and digit and not (lower and upper):
            return secrets.SINGLE_BITS
        if digit and lower and upper:
            return secrets.MIXED_BITS
        return secrets.ALNUM_BITS if run.isalnum() else secrets.BASE64_BITS

    def stretch(run, at):
        h = [-sum(c / w * math.log2(c / w) for c in Counter(run[i : i + w]).values()) for i in range(len(run) - w + 1)]
        above = [i for i, x in enumerate(h) if x > bits(run) + 1e-9]
        return [(at + above[0], at + above[-1] + w)] if above else []

    allowed = lambda x: any(re.fullmatch(a, x) for a in secrets.ALLOWED)
    for s, e in runs(token, text, inside):
        run = text[s:e]
        if allowed(run):
            continue
        each = stretch(run, s)
        for a, b in runs(token - set("+/_=-"), run):
            if (a, b) != (0, len(run)) and not allowed(run[a:b]):
                each += stretch(run[a:b], s + a)
        covered = set()
        for a, b in each:
            covered |= set(range(a, b - 1))  # stretches that only touch stay two
        for i in sorted(covered):
            if i - 1 not in covered:
                end = i
                while end in covered:
                    end += 1
                found.append(("entropy", i, end + 1))
    return sorted(found, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def test_secret_tables(spark, documents, empty):
    import hashlib

    rng = random.Random(12)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    wide = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    make = [lambda: draw(wide, rng.randrange(15, 60)), lambda: "token = " + draw(wide, 30), lambda: "AKIA" + draw("ABCDE0123", rng.randrange(10, 30)), lambda: draw("0123456789abcdef", rng.randrange(18, 60)), lambda: "plain words here", lambda: "a_long/" * rng.randrange(5), lambda: draw("ab1", 40), lambda: draw("ABCDEFGHIJ0123456789", 30), lambda: "ünï – 漢字"]
    rows = [(i, "".join(rng.choice(make)() + rng.choice([" ", "/", "-", "\n", ""]) for _ in range(rng.randrange(1, 8)))) for i in range(400)] + [(400, None), (401, ""), (402, draw(wide, 3000)), (403, "x" * 50000), (0, "AKIA")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    joined = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    expected = []
    for i, t in rows:
        spans = slow_spans(t or "")
        base = [x for x in spans if x[0] != "entropy"]
        expected.append((i, *[sum(k == x[0] for x in base) for k in secrets.KINDS[:3]], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
    got = sorted(tuple(r) for r in secrets.secret_digests(df, ["doc_id"]).collect())
    assert got == sorted(expected)
    assert sum("entropy" in x[5] for x in got) > 100
    assert secrets.secret_digests(documents, ["doc_id"]).count() == documents.count()
    assert secrets.find_secrets(empty, ["doc_id"]).count() == 0


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    ls = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(covered)


def test_rule_measures(spark, documents, sample, empty):
    extra = ["a b c a b c a b c", "x\x0by\x0cz\r\nx\x0by", "l1\nl1 \nl1\n\n\nl1", "a a a a", "# * $ % & | < >", "\u00a0nbsp\u2003em x"]
    rows = list(sample) + [(1000 + i, t) for i, t in enumerate(extra)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.measures(df, ["doc_id"]).collect())
    assert got == sorted((-1 if i is None else i, *measured(t)) for i, t in rows)
    kept = rules.filtered(documents.withColumn("n_words", F.lit("mine")))
    assert kept.columns == [*documents.columns, "n_words"]
    assert all(r["n_words"] == "mine" and measured(r["text"])[0] >= 50 for r in kept.collect())
    assert rules.filtered(empty).count() == 0


def test_thresholds_adapt(spark):
    rows = []
    for i in range(400):
        calm = i % 2
        words = [f"w{i}x{j}" + ("" if calm or j % 10 else "#") for j in range(80)]
        rows.append((i, "en", "calm" if calm else "code", " ".join(words)))
    odd = " ".join(f"q{j}##" for j in range(80))
    rows += [(1000, "en", "calm", odd), (1001, "en", "code", odd), (1002, None, None, " ".join(f"z{j}" for j in range(60)))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    from hopweave.llm.common import staged

    out = {r["doc_id"]: r["kept"] for r in rules.judged(staged(rules.with_values(rules.measures(df, ["doc_id", "lang", "source"])), "v")).collect()}
    assert not out[1000] and not out[1001] and out[1002]
    assert all(v for k, v in out.items() if k < 1000)


def test_lines(spark, empty):
    rng = random.Random(4)
    spread, near = "cookie notice of all sites", "only on nine sites"
    rows = []
    for i in range(200):
        own = [f"own line {i} {j} " + "text " * 8 for j in range(4)]
        site = f"s{i % 40}" if i % 50 else None
        if i % 3 == 0:
            own.insert(rng.randrange(5), spread + " ")
        if i % 40 < 9 and i % 50:
            own.append(near)
        rows.append((i, site, "\n".join(own)))
    rows += [(300, "s1", spread), (301, "s1", None), (302, "s2", ""), (303, "s2", f"\n\n{spread}\n" + "long tail " * 20), (0, "s0", rows[0][2])]
    rows += [(400 + i, f"s{i}", "a copy on many sites\nand its other line") for i in range(30)]
    rows += [(500, "s1", "subscribe now\nshort"), (501, None, "subscribe now")] + [(510 + i, f"s{i}", f"subscribe now\npage {i} " + "long " * 9) for i in range(11)]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, source string, text string, h int, line string")
    first, sites = {}, {}
    for _, s, t in rows:
        if t is not None and s:
            first[t] = min(s, first.get(t, s))
    for t, s in first.items():
        for x in t.split("\n"):
            if x.strip():
                sites.setdefault(x.strip(), set()).add(s)
    common = {x for x, s in sites.items() if len(s) >= lines.MIN_SITES}
    assert common == {spread, "subscribe now"}

    def clean(t):
        if t is None:
            return None
        return "\n".join(x for x in t.split("\n") if x.strip() not in common)

    expected = sorted((i, clean(t) or "") for i, _, t in rows)
    for bound in (lines.BROADCAST_BYTES, 0):
        out = lines.without_boilerplate(df, broadcast_bytes=bound)
        assert out.columns == [*df.columns, "__removed"]
        assert {r["doc_id"]: (r["text"], r["__removed"]) for r in out.collect()}[500] == ("short", 1)
        assert sorted((r["doc_id"], r["text"] or "") for r in out.collect()) == expected
    assert lines.without_boilerplate(empty).count() == 0


def test_lines_leave_every_text_but_copies(spark):
    notice = "cookie notice of all the sites there are"
    story = [f"story line {j} " + " ".join(f"w{j}x{k}" for k in range(12)) for j in range(5)]
    rows = [(i, f"s{i}", f"{notice}\nown {i}") for i in range(12)]
    rows += [(100 + i, f"s{i}", "\n".join([notice, *story])) for i in range(12)]
    rows += [(200 + i, f"s{i}", "\n".join([*story, f"end {i}"])) for i in range(12)]
    rows += [(300, "s1", notice), (301, "s1", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = {r["doc_id"]: r["text"] for r in lines.without_boilerplate(df, linked_copies=True).collect()}
    assert all(out[i] == f"own {i}" for i in range(12))
    assert all(out[100 + i] == "\n".join(story) for i in range(12))
    assert all(out[200 + i] == rows[24 + i][2] for i in range(12))
    assert out[300] == "" and out[301] is None and len(out) == len(rows)


def test_near_copies_of_lines(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    story = [" ".join(word() for _ in range(25)) for _ in range(6)]
    notice = " ".join(word() for _ in range(30))
    rows = []
    for i in range(14):  # each with another line altered in one word
        mine = list(story)
        mine[i % 6] = mine[i % 6].replace(mine[i % 6].split()[i], f"other{i}")
        rows.append((i, f"s{i}", "\n".join(mine)))
    # pages that are a notice over half, and otherwise their own
    rows += [(100 + i, f"s{i}", notice + "\n" + " ".join(word() for _ in range(20))) for i in range(14)]
    out = {r["doc_id"]: r["text"] for r in lines.without_boilerplate(spark.createDataFrame(rows, "doc_id long, source string, text string"), linked_copies=True).collect()}
    assert all(out[i] == text for i, _, text in rows[:14])
    assert all(out[i] == text.split("\n")[1] for i, _, text in rows[14:])

    texts = ["", None, " \t\n", "One", "a B\x0bc  d", "a b c d e", "a b c d e f a b c d e"]
    sizes = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(lines.shingle_sets(F.col("t"), 5))).collect()]
    tuples = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4)) if t.split()}
    assert [max(n, 0) if n is not None else 0 for n in sizes] == [len(tuples(t or "")) for t in texts]


def test_copy_groups_are_exact(spark, monkeypatch):
    """Copies without a line in common, and copies that no drawn partner finds: groups as from all pairs."""
    monkeypatch.setattr(lines, "COPY_PARTNERS", 1)
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    shared = [" ".join(word() for _ in range(8)) for _ in range(3)]
    texts = []
    for size in (1, 2, 5, 12):
        original = [[word() for _ in range(20)] for _ in range(6)]
        for i in range(size):
            mine = [list(x) for x in original]
            for j in rng.sample(range(6), rng.randrange(0, 4)) if size != 2 else range(3 * i):
                mine[j][rng.randrange(20)] = word()
            texts.append("\n".join([*(" ".join(x) for x in mine), *shared]))
    # every line altered
    long = [[word() for _ in range(80)] for _ in range(3)]
    texts += ["\n".join(" ".join(x) for x in long), "\n".join(" ".join([*x[:40], "z", *x[41:]]) for x in long)]
    texts = sorted(set(texts))
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "__key long, __key2 int, text string").cache()
    own = rows.select("__key", "__key2", F.explode(F.split("text", "\n")).alias("line")).select("__key", "__key2", F.xxhash64("line").alias("h")).cache()
    got = {}
    for r in lines.copy_groups(rows, own, lines.BROADCAST_BYTES).collect():
        got.setdefault(r["group"], set()).add(r["__key"])
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    reach = lambda a, b, share: len(sets[a] & sets[b]) * 100 >= share * len(sets[a] | sets[b])
    every = range(len(texts))
    linked = [a for a in every if any(a != b and reach(a, b, 80) for b in every)]
    of = {a: a for a in linked}
    for _ in linked:
        for a in linked:
            of[a] = min(of[b] for b in linked if reach(a, b, 60))
    expected = {}
    for a, g in of.items():
        expected.setdefault(g, set()).add(a)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values())) and len(expected) >= 3


def test_copies_apart_meet_few(spark, monkeypatch):
    """Texts of one original, few of them copies of another: the pairs that meet do not grow with all pairs."""
    monkeypatch.setattr(lines, "COPY_PARTNERS", 1)
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    original, texts = [word() for _ in range(120)], []
    for _ in range(150):
        mine = list(original)
        for _ in range(rng.randint(2, 3)):
            mine[rng.randrange(120)] = word()
        texts.append(" ".join(mine))
    met = []
    meeting = lines._meeting
    monkeypatch.setattr(lines, "_meeting", lambda *a: met.append(meeting(*a)) or met[-1])
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "__key long, __key2 int, text string").cache()
    own = rows.select("__key", "__key2", F.xxhash64("text").alias("h")).cache()
    got = {r["__key"] for r in lines.copy_groups(rows, own, lines.BROADCAST_BYTES).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    linked = [(a, b) for a in range(150) for b in range(a) if len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b])]
    assert got == {x for pair in linked for x in pair} and linked
    assert sum(m.count() for m in met) < len(linked) + 4 * len(texts)


def same_as_sql(df, sql, table, tmp_path, name):
    """Whether a query's rows are those of its SQL over ``table``, a list of (name, DataFrame)."""
    import duckdb

    con = duckdb.connect()
    for n, t in table:
        t.write.parquet(str(tmp_path / n))
        con.execute(f"create view {n} as select * from '{tmp_path / n}/*.parquet'")
    out = str(tmp_path / name)
    df.write.parquet(out)
    con.execute(f"create table o as {sql}")
    cols = ", ".join(c[0] for c in con.execute("describe o").fetchall())
    found = f"'{out}/*.parquet'"
    return [con.execute(f"select count(*) from (select {cols} from {a} except all select {cols} from {b})").fetchone()[0] for a, b in (("o", found), (found, "o"))] == [0, 0]


def test_quotes(spark, tmp_path):
    rows = [
        (1, 0, "u", "Hello there.\nHow are you today?"), (1, 1, "a", "> How are you today?\nFine, thanks."), (1, 2, "u", "> > How are you today?\n> Fine, thanks.\nGood to hear"),
        (1, 3, "a", "On Monday X wrote:\n> hello  THERE.\n> How are you today?\nlate answer"), (1, 4, "u", ">not known\nx"), (1, 5, "u", "> good TO hear"),
        (2, 0, "u", None), (2, 1, "u", ""), (2, 1, "u", "> a"), (None, 1, "u", "> Hello"), (3, None, "u", "z"), (1, 2, "u", "> > How are you today?\n> Fine, thanks.\nGood to hear"),
        (4, 0, "u", "Shall we meet?\nyes"), (4, 1, "a", "> yes\nwhere?"), (4, 2, "u", "yes"), (4, 3, "a", "> yes\nthen now"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {(r["conv_id"], r["turn"]): r for r in quotes.unquoted(df.withColumn("level", F.lit(1)).withColumn("body", F.lit("old"))).collect()}
    place = lambda t: (out[1, t]["reply_to_turn"], out[1, t]["thread_turn"], out[1, t]["depth"], out[1, t]["max_level"], out[1, t]["body"])
    assert place(1) == (0, 0, 1, 1, "Fine, thanks.")
    assert place(2) == (1, 0, 2, 2, "Good to hear")
    assert place(3) == (0, 0, 1, 1, "late answer")
    assert place(4) == (None, 4, 0, 1, "x")
    assert place(5) == (2, 0, 3, 1, "")
    # a short quote links to no line of a message, but to a message that consists of it
    assert (out[4, 1]["reply_to_turn"], out[4, 3]["reply_to_turn"]) == (None, 2)
    assert quotes.unquoted(df).count() == len(rows)
    # what follows from the first reply stands before the next reply
    assert [r["turn"] for r in quotes.conversations(df.filter("conv_id = 1")).collect()] == [0, 1, 2, 2, 5, 3, 4]
    assert quotes.unquoted(df.limit(0)).count() == 0
    assert same_as_sql(quotes.unquoted(df).select("conv_id", "turn", "role", *quotes.RESULTS), quotes.ORACLE, [("conversations", df)], tmp_path, "out")


def test_quotes_equal_sql_on_random_conversations(spark, tmp_path, monkeypatch):
    """Trees of replies with nested, partial, repeated and altered quotes; runs of a few turns."""
    monkeypatch.setattr(quotes, "TURNS", 4)
    rng = random.Random(11)
    say = lambda: "\n".join(" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "so", "yes"]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 4)))
    rows = []
    for conv in range(6):
        texts = []
        for turn in range(40):
            text = say()
            if texts and rng.random() < 0.8:
                lines = rng.choice(texts[-6:]).split("\n")
                cut = lines[: rng.randrange(1, len(lines) + 1)] if rng.random() < 0.5 else lines
                text = "\n".join(["> " + x.upper() if rng.random() < 0.2 else "> " + x for x in cut] + [text])
            texts.append(text)
            rows.append((conv, turn, "u", text))
    rows += rows[5:9] + [(0, 100, "u", "> " + "\n> ".join(["long line of many words"] * 5000)), (7, 0, "a", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    found = quotes.unquoted(df)
    assert found.filter("reply_to_turn is not null").count() > 100 and found.agg(F.max("depth")).first()[0] > 3
    assert same_as_sql(found.select("conv_id", "turn", "role", *quotes.RESULTS), quotes.ORACLE, [("conversations", df)], tmp_path, "out")


def test_long_reply_chain(spark):
    n = 70
    rows = [(1, i, "u", (f"> message number {i - 1}\n" if i else "") + f"message number {i}") for i in range(n)]
    rows += [(2, i, "u", "> the same words\nthe same words") for i in range(300)]  # one passage that all share
    out = {(r["conv_id"], r["turn"]): r for r in quotes.unquoted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all((out[1, i]["thread_turn"], out[1, i]["depth"], out[1, i]["place"]) == (0, i, i) for i in range(n))
    assert all(out[2, i]["reply_to_turn"] == (i - 1 if i else None) for i in range(300))


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i] + [0] * len(text)
        for j, c in enumerate(text, 1):
            new[j] = min(row[j - 1] + (a != c), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


def test_decontamination():
    rng = random.Random(5)
    for letters, tries in (("abc d", 150), ("abcdefgh ij", 150)):
        draw = lambda n: "".join(rng.choice(letters) for _ in range(n))  # noqa: B023, E731
        for _ in range(tries):
            item = decontaminate.normal(draw(rng.randrange(45, 80)))
            if len(item) < decontaminate.LEAST_CHARS:
                continue
            s = list(item)
            for _ in range(rng.randrange(9)):
                at, how = rng.randrange(len(s)), rng.random()
                s[at : at + (how > 0.3)] = [] if how > 0.6 else [rng.choice(letters)]
            text = decontaminate.normal(draw(rng.randrange(60)) + "".join(s) + draw(rng.randrange(60)) + item[:20] + draw(9))
            share = rng.choice([0.05, 0.1])
            least = distance(item, text)
            found = decontaminate.Matcher([(1, item)], share).find(text)
            assert (found[0][0] if found else None) == (least if least <= int(len(item) * share) else None)


def test_decontamination_tables(spark, empty):
    item = "what is the name of the third planet from the star in this list"
    bench = spark.createDataFrame([(1, item.upper()), (2, item), (3, "short"), (4, None), (None, item), (5, "some other question that nobody asks in any text at all")], "item_id long, text string")
    rows = [(10, "before " + item.replace(" ", "\n", 2) + " after"), (11, "before " + item.replace("third", "thirt") + " after"), (12, "nothing here"), (13, None), (14, ""), (None, item), (10, item)]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, item_id string")
    for part in (decontaminate.PART_CHARS, 20):
        found = sorted((r["doc_id"] or -1, r["item_id"], r["distance"]) for r in decontaminate.contaminated(docs.drop("item_id"), bench, part_chars=part).collect())
        assert found == sorted((d, i, k) for d, k in ((10, 0), (11, 1), (-1, 0), (10, 0)) for i in (1, 2))
        kept = decontaminate.decontaminated(docs, bench, part_chars=part)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [12, 13, 14]
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.decontaminated(docs, bench.limit(0)).count() == len(rows)


def test_short_items_are_found_unchanged(spark):
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "2 + 2"), (3, " \n"), (4, "")], "item_id long, text string")
    rows = [(1, "so: what is  the\ncapital of FRANCE? Paris"), (2, "what is the capital of france"), (3, "somewhat is the capital of france?"), (4, "12 + 2 or 2 + 23"), (5, "is 12 + 2, or 2 + 2"), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.contaminated(docs, bench).collect())
    assert found == [(1, 1, 0), (5, 2, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminated(docs, bench).collect()) == [2, 3, 4, 6]
