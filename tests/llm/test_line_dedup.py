from collections import Counter, defaultdict

from provrank.llm.line_dedup import drop_lines


def plain(rows, ratio=0.1, least=3):
    pages, seen = Counter(h for h, _ in rows), defaultdict(Counter)
    for h, t in rows:
        for x in set((t if t is not None else "").split("\n")) if t is not None else ():
            if x.strip(" "):
                seen[h][x] += 1
    bad = {h: {x for x, n in c.items() if n >= least and n > ratio * pages[h]} for h, c in seen.items()}
    kept = [("" if h is None else h, None if t is None else "\n".join(x for x in t.split("\n") if x not in bad.get(h, ()))) for h, t in rows]
    return sorted(kept, key=lambda x: (x[0], x[1] or "")), bad


def test_against_plain(spark):
    rows = [("a", f"menu\nbody {i}\n\nfooter") for i in range(12)] + [("a", "menu\nmenu"), ("b", "menu\nonly two"), ("b", "menu"), (None, "x\ny"), (None, "x"), (None, "x\nz"), ("c", None), ("c", ""), ("a", "menu\nbody 3\n\nfooter"), ("d", "k" * 200_000)]
    df = spark.createDataFrame([(i, h, t, 7) for i, (h, t) in enumerate(rows)], "doc_id long, source string, text string, N_LINES int")
    out = drop_lines(df).collect()
    want, bad = plain(rows)
    assert sorted(("" if r.source is None else r.source, r.text) for r in out if r.text is not None) == [x for x in want if x[1] is not None]
    assert bad["a"] >= {"menu", "footer"} and bad[None] == {"x"} and not bad.get("b")
    by = {r.doc_id: r for r in out}
    assert by[12].text == "" and by[12].n_dropped == 2 and by[18].text is None and by[18].n_lines == 0
    assert by[19].text == "" and by[19].n_dropped == 0
    assert drop_lines(df.limit(0)).count() == 0
