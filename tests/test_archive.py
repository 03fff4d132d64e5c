import json

import pytest

from corpusloom.sources import archive


def pages(tmp_path, sizes):
    for n, size in enumerate(sizes):
        (tmp_path / f"page={n}").mkdir()
        (tmp_path / f"page={n}" / "part-0.txt").write_text("\n".join(json.dumps({"id": n * 100 + k, "slug": f"s{n}"}) for k in range(size)))
    return f"file://{tmp_path}"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 9, 33])
def test_only_an_empty_page_ends_it(tmp_path, n):
    reader = archive.PageReader(pages(tmp_path, [2 - k % 2 for k in range(n)] + [0]), 4)
    looked = []
    empty, reader.empty = reader.empty, lambda p: looked.append(p) or empty(p)
    assert reader.end() == n and len(looked) <= 14
    ranges = [(p.first, p.last) for p in reader.partitions()]
    assert [k for a, b in ranges for k in range(a, b)] == list(range(n))


def test_items_once(spark, tmp_path):
    path = pages(tmp_path, [4, 1, 4, 0])
    (tmp_path / "page=1" / "part-1.txt").write_text('{"id": 2, "slug": "again"}\nno json\n{"slug": "without"}\n')
    (tmp_path / "page=2" / "_SUCCESS").write_text("x")
    rows = archive.walked(spark, path, "id long, slug string", "id", 2).collect()
    assert sorted((r.id, r.page, r.slug) for r in rows) == [(k, 0, "s0") for k in range(4)] + [(100, 1, "s1")] + [(200 + k, 2, "s2") for k in range(4)]
    (tmp_path / "none").mkdir()
    assert archive.walked(spark, f"file://{tmp_path}/none", "id long", "id").count() == 0
