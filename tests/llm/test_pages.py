import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from chronofact.llm import urlrules, warc


@given(st.lists(st.lists(st.integers()), max_size=9))
def test_loser_tree(runs):
    assert list(warc.merged([iter(sorted(r)) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_warc(spark):
    big, small = "<html>" + "x" * 200, "tiny"
    rows = [(5, "http://b.org/", big), (2, "http://a.org/1", big), (9, None, big), (7, "http://a.org/2", small), (8, "http://a.org/2", small), (1, "http://ü.org/\r\nX: y", ""), (3, "http://a.org/3", None), (4, "x", "ü" * 99), (6, "x", "ü" * 99), (None, "http://c.org", big), (2, "http://a.org/1", big)]
    pages = spark.createDataFrame([(*r, "p", 1) for r in rows], "page_id long, url string, html string, path string, at long")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.record_type in ("response", "revisit")
    by_id = {}
    for r in got:
        by_id.setdefault(r.page_id, []).append(r)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((r.record_type, r.refers_to) for r in by_id[2]) == [("response", None), ("revisit", 2)]
    for i in (5, 9, None):
        (r,) = by_id[i]
        assert (r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) == ("revisit", 2, len(big), sha(big))
    assert by_id[7][0].record_type == by_id[8][0].record_type == "response"
    assert by_id[1][0].payload_bytes == by_id[3][0].payload_bytes == 0 and by_id[3][0].payload_digest == sha("")
    assert by_id[6][0].refers_to == 4 and by_id[6][0].payload_bytes == 198 and bytes(by_id[4][0].payload).decode() == "ü" * 99
    order = sorted(got, key=lambda r: (r.part, r.position))
    assert [(r.url_key, r.timestamp) for r in order] == sorted((r.url_key, r.timestamp) for r in got)
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [1, 3])
def test_one_response_for_each_digest_whatever_reads_it(spark, copies):
    rows = [(i, f"http://a.org/{i % 5}", f"page {i % 50} " * 30) for i in range(400)] * copies + [(10**12, "u", "x" * 200), (-(10**11), "u", "y" * 200), (2**63 - 1, None, "z"), (-(2**63), None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    marked = warc.mark_revisits(pages)
    for columns in (["digest", "revisit"], ["digest", "revisit", "url", "payload"]):
        responses = marked.select(*columns).where("NOT revisit").groupBy("digest").count()
        assert responses.where("count <> 1").count() == 0 and responses.count() == 54
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows) and sum(r.record_type == "response" for r in got) == 54
    assert {r.refers_to for r in got if r.page_id is not None and 0 <= r.page_id < 400 and r.record_type == "revisit"} == set(range(50))


def test_archives_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """A task that runs again may get its rows in another order; what it writes is the same."""
    rows = [(i % 7, f"http://h{i % 3}.org/{i % 5}", "<p>" + "x" * (90 + i % 4 * 20)) for i in range(40)]
    found = []
    for k in range(3):
        folder = tmp_path / str(k)
        lines = warc.write(spark.createDataFrame(random.Random(k).sample(rows, len(rows)), "page_id long, url string, html string").coalesce(1), f"file://{folder}")
        assert lines.count() == len(rows)
        found.append([p.read_bytes() for p in sorted(folder.glob("*.gz"))])
    assert found[0] == found[1] == found[2] and len(found[0]) == 1


def expected(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in urlrules.PREFIXES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best


URLS = [
    None, "", "no scheme", "http://", "https://ORG/", "http://x.org", "http://x.org?y", "http://x.org/a", "http://example.org/es/1", "http://a.example.org/es/", "http://example.org/ES/",
    "http://example.org/en/1", "http://example.org/en/123", "http://example.org/en/21", "http://notexample.org/es/", "http://x.com/fr/a", "http://x.com/fr", "http://x.com/de/#t", "http://com/de/x",
    "http://xcom/de/x", "http://x.com:80/de/x", "http://spam-farm.example.net/", "http://x.net/casino/", "http://x.net/casinos/", "http://a/b://c.org/", "http://ÄÖ.org/ü", "http://x.net/a\nb",
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, rule string, verdict string")
    got = {r.page_id: r for r in urlrules.judge(pages).collect()}
    assert len(got) == 2 * len(URLS)
    for i, u in enumerate([*URLS, *URLS]):
        host, path, best = expected(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[0]), u
        blocked = best[1] if best else "block" if u and ("spam-farm.example.net" in u or "/casino/" in u) else "allow"
        assert got[i].verdict == blocked, u
    assert urlrules.judge(pages.limit(0)).count() == 0


def test_rules_are_indexed_by_their_rarest_token(spark):
    from pyspark.sql import functions as F

    targets = spark.createDataFrame([("a/x",), ("a/y",), ("b/a",)], "_target string").withColumn("tokens", urlrules.tokens(F.col("_target")))
    rules = urlrules.rule_table(spark, [], [("r1", "block", "a/x", ["a", "x"]), ("r2", "block", "zz", ["a", "zz"]), ("r3", "block", ".", [])])
    assert {r["name"]: r["token"] for r in urlrules.rule_index(targets, rules).collect()} == {"r1": "x", "r2": "zz", "r3": None}


@pytest.mark.parametrize("seed", [1, 2])
def test_index_finds_what_all_rules_would(spark, seed):
    rng = random.Random(seed)
    tokens = [f"t{i}" for i in range(8)]
    patterns = [(f"r{i}", "block", "/".join(p), list(p)) for i in range(6) for p in [rng.sample(tokens, 2)]]
    urls = ["http://h.net/" + "/".join(rng.choices(tokens, k=4)) for _ in range(60)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlrules.judge(pages, urlrules.rule_table(spark, [], patterns)).collect()}
    assert got == {i: "block" if any(p[2] in u for p in patterns) else "allow" for i, u in enumerate(urls)}


def fits(rule, text):
    """Whether a line of a list matches a lower-cased host and path: characters tried one after another."""
    core, starts = rule.removeprefix("||") if rule.startswith("||") else rule.removeprefix("|"), range(len(text) + 1)
    if rule.startswith("||"):
        host_end = text.index("/") if "/" in text else len(text)
        starts = [0] + [k + 1 for k in range(host_end) if text[k] == "."]
    elif rule.startswith("|"):
        starts = [0]
    end = core.endswith("|")
    core = core.removesuffix("|")

    def at(i, k):
        if i == len(core):
            return not end or k == len(text)
        if core[i] == "*":
            return any(at(i + 1, j) for j in range(k, len(text) + 1))
        if core[i] == "^" and k == len(text):
            return at(i + 1, k)
        if k == len(text):
            return False
        return (not (text[k].isalnum() or text[k] in "_-.%") if core[i] == "^" else core[i] == text[k]) and at(i + 1, k + 1)

    return any(at(0, k) for k in starts)


def test_lines_of_a_filter_list_are_those_of_brute_force(spark):
    rng = random.Random(11)
    letters = "abc"
    word = lambda: "".join(rng.choices(letters, k=rng.randrange(1, 6)))
    rules = {rng.choice(["", "", "|", "||"]) + "".join(word() + rng.choice(["*", "^", "/", ".", "-", "_", ""]) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", "|"]) for _ in range(150)}
    rules = sorted(r for r in rules if not (r.startswith("/") and r.endswith("/")))
    targets = sorted({".".join(word() for _ in range(2)) + rng.choice(["", ":80"]) + "".join("/" + rng.choice(["", "-", "_"]).join([word(), word()]) for _ in range(rng.randrange(3))) for _ in range(120)})
    blocks, allows = rules[::2], rules[1::4]
    lines = spark.createDataFrame([(x,) for x in [*blocks, *blocks[:3], *["@@" + x for x in allows], None, "", "! note", "x.org##.ad", "||abc.$script", "*", "||", "|http://a", "/a?b"]], "value string")
    parsed = urlrules.parse_list(lines)
    assert {r["name"]: r.skipped for r in parsed.where("skipped IS NOT NULL").collect()} == {
        "": "comment", "! note": "comment", "x.org##.ad": "cosmetic", "||abc.$script": "options", "*": "everything", "||": "everything", "|http://a": "scheme", "/a?b": "query",
    }
    pages = spark.createDataFrame([(i, "http://" + t.upper()) for i, t in enumerate(targets)], "page_id long, url string")
    # the path keeps its case; rules ignore it
    for default in ("allow", "block"):
        got = {r.page_id: r.verdict for r in urlrules.judge(pages, parsed, default=default).collect()}
        wanted = {i: "allow" if any(fits(r, t) for r in allows) else "block" if any(fits(r, t) for r in blocks) else default for i, t in enumerate(targets)}
        assert got == wanted
    one = urlrules.judge(pages, urlrules.parse_list(lines.limit(0)))
    assert {r.verdict for r in one.collect()} == {"allow"}


def test_rules_without_tokens_go_by_runs_or_blocks(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "BLOCK", 2)
    lines = ["bcde*xyz", "||a.org^$match-case", "/UP$match-case", "127.0.0.1 bad.net # note", *[rf"/\/{k}[0-9]+$/" for k in range(5)]]
    parsed = urlrules.parse_list(spark.createDataFrame([(x,) for x in lines], "value string"))
    urls = ["http://abcdef.org/wxyz", "http://x.a.org/", "http://xa.org/", "http://x.org/UPPER", "http://x.org/upper", "http://www.bad.net", "http://x.org/37", "http://x.org/7", None, "x"]
    got = {r.page_id: r.verdict for r in urlrules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), parsed).collect()}
    assert {k for k, v in got.items() if v == "block"} == {0, 1, 3, 5, 6}
