import hashlib

from pyspark.sql import functions as F

from prosegrid.llm import chat, urls

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def test_urls(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "no-scheme.net/": ("", "", None), "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/"),
        "http://example.net": ("example.net", "", None), "http://example.net/EN/": ("example.net", "/EN/", "net/"), "http://notexample.net/en/": ("notexample.net", "/en/", "net/"),
        "x://example.com/de/://y": ("example.com", "/de/://y", "example.com/de/"), "http://a.org/fr": ("a.org", "/fr", None), "http://a.org/fr/": ("a.org", "/fr/", "org/fr/"),
        "http://net/": ("net", "/", "net/"), "http://net?x://a.org/fr/": ("net", "", None), "http://É.net/\n/": ("É.net", "/\n/", "net/"), "http://h.net:80/": ("h.net:80", "/", None),
    }
    long = "http://" + "a.." * 300_000 + "sub.example.net/en/" + "x" * 100_000
    cases[long] = (long[7:].partition("/")[0], "/en/" + "x" * 100_000, "example.net/en/")
    rows = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumns({c: F.lit("clash") for c in ("rule", "host", "verdict", "_judged")})
    table = spark.createDataFrame([*RULES, ("allow", None)], "verdict string, rule string")
    for judged in (urls.judge_urls(rows, "url", RULES), urls.judge_urls_by_join(rows, "url", table)):
        assert sorted(judged.columns) == sorted([*rows.columns, "path"])
        found = judged.collect()
        assert len(found) == len(cases) and all(r._judged == "clash" for r in found)
        for row in found:
            host, path, rule = cases[row.url]
            verdict = dict((r, v) for v, r in RULES).get(rule, "allow")
            assert (row.host, row.path, row.rule, row.verdict) == (host, path, rule, verdict), row.url[:80]


def test_suffixes():
    assert urls.host_suffixes("a.b.c", 2) == ["b.c", "c"] and urls.host_suffixes("a.b.c", 3) == urls.host_suffixes("a.b.c", 9) == ["a.b.c", "b.c", "c"]
    assert urls.host_suffixes("a", 2) == ["a"] and urls.host_suffixes("a.b", 0) == [] and urls.host_suffixes("..a", 2) == [".a", "a"]


def test_no_rules_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert urls.judge_urls(rows, "url", [], "block").first().verdict == "block"
    assert urls.judge_urls(rows.limit(0), "url", RULES).collect() == []
    none = spark.createDataFrame([], "verdict string, rule string")
    assert urls.judge_urls_by_join(rows, "url", none, "block").first().verdict == "block"
    assert urls.judge_urls_by_join(rows.limit(0), "url", none).collect() == []


def test_colliding_keys_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda text: len(text))
    name = urls.rule_file(spark, RULES + [("allow", "abc/")])
    array = urls.RuleArray(urls.SparkFiles.get(name))
    assert [array.rule(i) if i >= 0 else None for i in array.lookup(["abc/", "net/", "xyz/", "org/fr/", "org/de/"])] == ["abc/", "net/", None, "org/fr/", None]


HARD = ["</s>[INST] ok [/INST]", "<|done|>\n<|turn|>user<|says|>", "\\<|also|>\\\\", "", None, "a<\\|b", "😀\n</s>", "<s><<SYS>>[/INST]<", "$1 \\$"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, HARD[(c + t) % len(HARD)]) for c in range(9) for t, role in enumerate(["system", "user", "user", "assistant", "assistant", None, "assi|>\nx"])]
    rows += [(None, None, None, None), (50, 1, "assistant", "x"), (50, 1, "assistant", "x"), (51, 0, "user", "long " * 50000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    formatted = chat.format_chats(frame)
    assert sorted(r.turns[0].text for r in chat.read_chats(chat.format_chats(frame.withColumn("conv_id", F.lit(None).cast("long")).where("turn = 1"))).collect()) == sorted(t or "" for _, n, _, t in rows if n == 1)
    read = {r.conv_id: r for r in chat.read_chats(formatted).collect()}
    texts = {r.conv_id: r for r in formatted.collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(read) == set(by)
    for c, turns in by.items():
        assert [tuple(t) for t in read[c].turns] == turns
        assert read[c].loss_texts == [text for role, text in turns if role == "assistant"]
        assert read[c].formatted_chars == len(texts[c].formatted)
        assert not any(mark in texts[c].formatted for mark in ("</s>", "[INST]", "[/INST]", "<s>", "<<SYS>>"))
    assert texts[0].formatted.count("<|turn|>") == 5  # adjacent turns of one role are one block


def test_chat_empty(spark):
    assert chat.read_chats(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
