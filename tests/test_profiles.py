"""The parser of pasted lists against a plain one, on the given pages and on what people paste."""

import html as entities
import re

from chronofact.sources import profiles

ROOT = "/root/testdata/sf0.01"
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[a-z/!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|<|[^<]+", re.S | re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")


def brute(text):
    """username: (pos, name), and the number of links and of those to profiles."""
    depth, links, seen, order, current = 0, [], {}, [], None
    for pos, m in enumerate(TOKEN.finditer(text or "")):
        t = m[0]
        if re.match(r"<(!--|script\b|style\b)", t, re.I):
            continue
        if re.match(r"<(a|button)[\s>/]", t, re.I):
            depth += 1
        elif re.match(r"</(a|button)[\s>]", t, re.I):
            depth -= 1
        if re.match(r"<a\s", t, re.I):
            found = [a for a in ATTRIBUTE.finditer(t) if a[1].lower() == "href"]
            if found:
                target = entities.unescape(next((g for g in found[0].groups()[1:] if g), "")).strip(" ")
                p = re.match(r"(?:(?:https?:)?//[^/?#]+)?/([A-Za-z0-9._]{1,30})/?(?:[?#].*)?$", target)
                name = p[1] if p and p[1].lower() not in profiles.RESERVED else None
                links.append(name)
                if name:
                    current = name
                    seen.setdefault(name, [pos, None])
        elif not t.startswith("<") and depth <= 0 and current and seen[current][1] is None:
            shown = re.sub(r"\s+", " ", entities.unescape(t).replace("\xa0", " ")).strip(" ")
            if shown and not re.match(profiles.SEPARATOR, shown):
                seen[current][1] = shown
    order = {u: (pos, None if name == u else name) for u, (pos, name) in seen.items()}
    return order, len(links), sum(x is not None for x in links)


def check(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, html string")
    found, report = profiles.profile_lists(df)
    got = {}
    for r in found.collect():
        got.setdefault(r.page_id, {})[r.username] = (r.pos, r.display_name)
    status = {r.page_id: (r.n_links, r.n_profiles, r.status) for r in report.collect()}
    for i, text in rows:
        people, n, k = brute(text)
        want = "no links" if not k else "whole page" if k / n < 0.5 else "list"
        assert status[i] == (n, k, want), (i, status[i])
        assert got.get(i, {}) == (people if want == "list" else {}), i
    return got, {r.username: r.ambiguous for r in found.collect()}


def test_given_pages(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{ROOT}/pages.parquet").select("page_id", "html").collect()]
    got, _ = check(spark, rows)
    assert len(got) > 50


def test_what_people_paste(spark):
    person = '<div><a href="/{0}/"><img alt="x"></a><div><a class=b href=\'https://www.site.org/{0}/?hl=de\'><span>{0}</span></a> · <span>{1}</span></div><button>Follow</button></div>'
    rows = [
        (1, person.format("ann_1", "Ann &amp; Co") + person.format("bob.b", "bob") + person.format("ann_1", "Ann again") + person.format("cy", "cy")),
        (2, "<a href=/x.y>x</a><A HREF='/explore/'>all</A><a name=q>no</a><a href='/a/b'>deep</a> text"),
        (3, "<a href='/one'>1</a><a href='/two'>2</a><a href=/p/>p</a> <b>Two</b> &nbsp; Name"),
        (4, None), (5, ""), (6, "plain text, no links < > & <"), (7, "<!-- <a href='/hidden'>h</a> --><script>var a = \"<a href='/js'>\"</script><a href='/real'>r</a><button>Real</button>Name\n  of  it"),
        (8, "<a data-href='/no' href=\"/yes\" title='a > b'>y</a> shown <a href=\"\">empty</a> " + "<p>long</p>" * 3000), (9, "<a href='/open'>never closed"), (10, "<button><a href='/in'>in</a></button> lower_case"),
    ]
    got, ambiguous = check(spark, rows)
    assert {u: n for u, (_, n) in got[1].items()} == {"ann_1": "Ann & Co", "bob.b": "bob", "cy": None}
    assert 2 not in got and got[7] == {"real": (got[7]["real"][0], "Name of it")} and got[3]["two"][1] == "Two" and got[3]["one"][1] is None
    assert ambiguous["in"] and ambiguous["bob.b"] and not ambiguous["real"]
