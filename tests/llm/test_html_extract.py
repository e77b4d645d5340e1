import random
import re

import pytest

from condensa.llm.html_extract import common_lines, extract_main_text, lines_of, main_text


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = row[:]
        for j, y in enumerate(b):
            row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("seed", range(40))
def test_common_lines_is_a_longest_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = ([rng.choice("abcdef"[: rng.randint(1, 6)]) for _ in range(rng.randint(0, 30))] for _ in range(2))
    got = common_lines(a, b)
    assert got == sorted(set(got)) and len(got) == lcs_length(a, b)
    at = 0
    for i in got:
        at = b.index(a[i], at) + 1


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("<p>a  b\n c&amp;d&#39;s &nbsp; e</p><p>f", "a b c&d's e\nf"),
        ("<article><h1>T</h1><p><b>one<br><p>two</p></article><footer>&copy; x</footer>", "T\none\ntwo"),
        ("<nav><ul><li>menu</li></ul></nav><div>text <i>in</i>line</div><script>var a='</p>';</script><style>p{}</style>", "text inline"),
        ("<div class='ad'>buy</div><div id=cookie-notice>ok?</div><aside>s</aside><form><p>f</form><p>kept", "kept"),
        ("<article><p>x</p><section class='comments'><p>c1</p><p>c2</p></section><p>y</p></article><p>outside", "x\ny"),
        ("<p>shadow of adventure <span class='ad-slot'>buy</span> goes on</p>", "shadow of adventure goes on"),
        ("<p>a<!-- <p>no</p> -->b</p><p title='1>0'>c", "ab\nc"),
        ("<p>cut &am", "cut &am"),
        ("<main><p>1 < 2 and 3 > 2</p></main>", "1 < 2 and 3 > 2"),
    ],
)
def test_one_page(page, text):
    assert main_text(lines_of(page), []) == text


def test_shared_lines_of_neighbours_go(spark):
    frame = "<div>Site of things</div>{}<div>Read more here</div>"
    rows = [(i, f"http://h.example/a/{i}", frame.format(f"<div>Story number {i}</div><div>It goes on {i}</div>"), i) for i in range(9)]
    rows += [(20, "http://h.example/a/20", rows[8][2], 0), (21, None, None, 0), (None, "x", "<p>p", 0), (22, "http://other.example/", frame.format(""), 1)]
    rows += [(30, "http://h.example/z", "<div>Site of things</div><article><p>Read more here</p></article>", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_main_text(df).collect()}
    assert len(got) == len(rows)
    for i in range(8):
        want = f"Story number {i}\nIt goes on {i}"
        assert got[i] == (want, len(want))
    assert got[21] == ("", 0) and got[None] == ("p", 1)
    assert got[22][0] == "Site of things\nRead more here"
    assert got[30][0] == "Read more here"


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract_main_text(df).collect() == []


def brute(rows, reach=3):
    """Texts by looking at all pages of each host in order of path, in plain Python."""
    hosts = {}
    for page_id, url, page in rows:
        m = re.match(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)(.*)$", url or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", url or "")
        hosts.setdefault(host, []).append((path.encode(), page, page_id, path))
    out = {}
    for own in hosts.values():
        for path, page, page_id, address in own:
            # Places of the host in which equal pages side by side are one.
            order = []
            for x in sorted(own, key=lambda x: (x[0], digests[x[1]])):
                if not order or order[-1][0][1] != x[1]:
                    order.append([])
                order[-1].append(x)
            at = next(i for i, run in enumerate(order) if any(x[0] == path and x[1] == page for x in run))
            split = lambda t: re.split(r"[/?&#=.]", t)
            near = []
            for j in range(max(0, at - reach), min(len(order), at + reach + 1)):
                if order[j][0][1] != page:
                    a, b = split(order[at][0][3]), split(order[j][0][3])
                    agree = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                    near.append((-agree, abs(j - at), j))
            out[page_id] = main_text(lines_of(page), [lines_of(order[j][0][1]) for *_, j in sorted(near)])
    return out


digests: dict = {}


def test_equals_brute_force_whatever_the_partitions(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        host = rng.choice(["big.example"] * 8 + ["a.example", "b.example", "one%d.example" % i])
        frame = [f"Menu of {host}", f"About {host}", "Subscribe now"]
        body = "".join(f"<div>{x}</div>" for x in frame) + "".join(f"<div>Line {rng.randrange(10**6)} of a story</div>" for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.3:
            body = f"<article><div>Share this page</div><p>Text {rng.randrange(10**6)}</p><p>Shared words</p></article>" + body
        rows.append((i, f"http://{host}/s{rng.randrange(4)}/{rng.randrange(300)}", body))
    # A run of copies longer than any reach, and near the ends of hosts.
    rows += [(1000 + i, f"http://big.example/s2/{100 + i}", rows[0][2]) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    digests.update({r.html: r.d for r in df.selectExpr("html", "xxhash64(html) d").collect()})
    want = brute(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("4", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {r.page_id: r.text for r in extract_main_text(df).collect()}
            assert got == want
        plain = {r.page_id: r.text for r in extract_main_text(df, differencing=False).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # Differencing decides: frames of undeclared pages and loose lines of articles go, paragraphs that pages share stay.
    bare = [r[0] for r in rows if "//big.example" in r[1] and "<article>" not in r[2]]
    declared = [r[0] for r in rows if "//big.example" in r[1] and "<article>" in r[2]]
    assert all("Menu of" in plain[i] and "Menu of" not in want[i] and "story" in want[i] for i in bare)
    assert 0 < sum("Share this page" not in want[i] for i in declared) and all("Share this page" in plain[i] and "Shared words" in want[i] for i in declared)
