from collections import Counter

from inkwell.llm.line_dedup import line_dedup


def test_against_brute_force(spark):
    rows = [(i, f"https://u@{'Big' if i % 3 else f'h{i % 5}'}.example.com:80/{i}", f"<html><style>x</style><p>menu</p><div> line {i % 4} <b>x</b></div>text {i}<br>text {i}<!-- c --></html>") for i in range(60)]
    rows += [(100, None, "<p>a</p>"), (101, "no url", None), (102, "http://h1.example.com", "")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, host string, n int")
    lines = {i: ["menu", f"line {i % 4} x", f"text {i}", f"text {i}"] for i in range(60)} | {100: ["a"], 101: [], 102: []}
    host = {i: ("big" if i % 3 else f"h{i % 5}") + ".example.com" for i in range(60)} | {100: "", 101: "", 102: "h1.example.com"}
    pages, seen = Counter(host.values()), Counter((host[i], x) for i in lines for x in set(lines[i]))
    out = {r.page_id: r for r in line_dedup(df).collect()}
    for i, r in out.items():
        kept = [x for x in lines[i] if not (seen[host[i], x] >= 3 and seen[host[i], x] > 0.3 * pages[host[i]])]
        assert (r.host, r.n_lines, r.n_dropped, r.text) == (host[i], len(lines[i]), len(lines[i]) - len(kept), "\n".join(kept))
    assert len(out) == 63 and sum(r.n_dropped for r in out.values()) >= 60
    assert line_dedup(df.limit(0)).collect() == []
