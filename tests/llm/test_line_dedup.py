import random
from collections import defaultdict

from tidebook.llm.line_dedup import dedup_lines, site_lines, widespread_lines


def brute(rows, min_sites):
    bare = lambda x: x.strip(" \t\r")
    sites, keeper = defaultdict(set), {}
    for doc, text, site in rows:
        for line in (text or "").split("\n") if text is not None else []:
            if bare(line):
                sites[bare(line)].add(site or "")
                if doc is not None:
                    keeper[bare(line)] = min(doc, keeper.get(bare(line), doc))
    out = []
    for doc, text, _ in rows:
        if text is None:
            out.append((doc, 0, 0, None))
            continue
        lines = text.split("\n")
        left = [x for x in lines if not (bare(x) and len(sites[bare(x)]) >= min_sites and keeper.get(bare(x)) != doc)]
        out.append((doc, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def test_against_brute_force(make_docs):
    rnd = random.Random(1)
    pool = [f"line {i}" for i in range(30)] + ["", "  ", "\t", " menu ", "menu", "menu\r"]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(0, 9))), rnd.choice(["a", "b", "c", "d", None])) for i in range(80)]
    rows += [(80, None, "a"), (81, "", "b"), (81, "", "b"), (82, "menu", None), (None, "menu\nline 1", "z"), (83, "menu\n" * 2000, "a")]
    for least in (2, 3, 5):
        found = dedup_lines(make_docs(rows), min_sites=least)
        assert {"lang", "score", "line"} <= set(found.columns)
        got = sorted((tuple(r) for r in found.select("doc_id", "n_lines", "n_removed", "text").collect()), key=str)
        assert got == brute(rows, least)


def test_many_sites_are_decided_by_sketch_or_exactly(spark, make_docs):
    rows = [(i, f"everywhere\n{'half' if i % 2 else 'other'}\nown {i}", f"site{i}") for i in range(600)]
    lines = site_lines(make_docs(rows))
    assert widespread_lines(lines, min_sites=300).count() == 3  # 600 is clear, 300 and 300 lie on the threshold
    assert widespread_lines(lines, min_sites=301).count() == 1
    assert widespread_lines(lines, min_sites=601).count() == 0


def test_many_rows_without_an_id_and_ids_with_several_texts(spark, make_docs):
    rnd = random.Random(2)
    pool = [f"line {i}" for i in range(40)]
    rows = [(None, "\n".join(rnd.choices(pool, k=rnd.randint(1, 6))), f"s{i % 7}") for i in range(150)]
    rows += [(i % 3, "\n".join(rnd.choices(pool, k=4)), f"s{i % 5}") for i in range(30)] + rows[:20]
    rows += [(None, "\n".join(f"long {i % 9000}\n{pool[i % 40]}" for i in range(20_000)), "s1")]
    found = dedup_lines(make_docs(rows), min_sites=4)
    assert sorted((tuple(r) for r in found.select("doc_id", "n_lines", "n_removed", "text").collect()), key=str) == brute(rows, 4)
    lines = site_lines(make_docs([(None, f"a{i}\nmenu", f"s{i}") for i in range(50)]))
    groups = lines.groupBy("row_a", "row_b").count()
    assert groups.count() == 50 and groups.agg({"count": "max"}).first()[0] == 2  # no group for all null ids


def test_empty_table(make_docs):
    assert dedup_lines(make_docs([])).count() == 0
