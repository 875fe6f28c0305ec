from __future__ import annotations

from alertloom.llm import licenses
from alertloom.llm.queries import op7_license_scan
from tests.llm.conftest import SF

STATED = {
    "https://a.org/lib/LICENSE": "<p>Released under the MIT License.</p>",
    "https://a.org/lib/deep/page.html": "<p>words only</p>",
    "https://a.org/lib/deep/own.html": "<div>Text. Licensed under CC BY-NC 4.0.</div>",
    "https://a.org/lib/deep/more/": "<p>Licensed under the Apache License, Version 2.0.</p>",
    "https://a.org/lib/deep/more/x.html?a=/b/": "<p>x</p>",
    "https://a.org/other.html": "<p>a driving licence is something else entirely, says the office of roads</p>",
    "https://b.org/lib/deep/page.html": "<p>x</p>",
    "https://b.org/COPYING": "<p>This work is licensed under the GNU General Public License, version 3.</p>",
}


def test_own_and_inherited(spark):
    rows = [(k, url, html, "x", 1) for k, (url, html) in enumerate(STATED.items())]
    pages = spark.createDataFrame([*rows, (90, None, None, "x", 1), (91, "https://a.org/lib/n", None, "x", 1), (0, *rows[0][1:])],
                                  "page_id long, url string, html string, folder string, depth int")
    got = sorted((r.page_id, r.licence, r.basis, r.folder) for r in licenses.scan_licences(pages).collect())
    assert got == [
        (0, "MIT", "own", None), (0, "MIT", "own", None), (1, "MIT", "inherited", "lib"), (2, "CC-BY-NC-4.0", "own", None),
        (3, "Apache-2.0", "own", None), (4, "Apache-2.0", "inherited", "lib/deep/more"), (5, None, None, None),
        (6, "GPL-3.0", "inherited", ""), (7, "GPL-3.0", "own", None), (90, None, None, None), (91, "MIT", "inherited", "lib"),
    ]
    assert licenses.scan_licences(pages.limit(0)).count() == 0


def test_query_covers_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in op7_license_scan(spark, SF).collect()}
    assert got.keys() == {r.page_id for r in pages.select("page_id").collect()}
    for r in pages.collect():
        for name, text in (("MIT", "Released under the MIT License."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
                           ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.")):
            if text in r.html:
                assert got[r.page_id].basis == "own" and got[r.page_id].licence == name


def test_notices_are_found_whatever_stands_beside_them(spark):
    notices = {
        "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "Proprietary",
        "This program is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the <a href=x>Apache\nLicense</a>, Version 2.0": "Apache-2.0",
        **{texts[0]: name for name, texts in licenses.TEMPLATES.items()},
        "The licence of a driver, by 4.0 million people.": None, "All licenses are sold under the counter.": None,
        "Copyright of the general public": None, "Some rights reserved, see the licence": None,
    }
    shapes = ["<title>{0}</title><p>x</p>", "<p>Nine words of prose that stand just before it<p>{0}</p>", "<p>{0}<br>Other words",
              "<footer>&copy; host.example.org &middot; Im schtepf den {0} &copy; host.example.org ut nont</footer>",
              "<script>var t='</p>';</script>{0}<!-- <p> --> words go on after this one without any end of it"]
    # thousands of footers that differ must not change what a notice weighs
    html = [(shape.format(text), want) for text, want in notices.items() for shape in shapes]
    rows = [(k, f"https://h{k}.org/a/p.html", text) for k, (text, _) in enumerate(html)]
    rows += [(10_000 + k, f"https://f{k}.org/a/p.html", f"<p>Copyright host{k} version 3 gnu") for k in range(2000)]
    got = {r.page_id: r.licence for r in licenses.scan_licences(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, (text, want) in enumerate(html):
        assert got[k] == want, text
    assert all(got[10_000 + k] is None for k in range(2000))


def test_every_literal_notice_of_the_tables(spark):
    for size in ("sf0.01", "sf0.1"):
        folder = f"/root/testdata/{size}"
        got = {r.page_id: r for r in op7_license_scan(spark, folder).collect()}
        for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
            said = [name for name, text in (
                ("MIT", "Released under the MIT License."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
                ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
                ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Proprietary", "All rights reserved."))
                if text in r.html]
            assert not said or (got[r.page_id].basis == "own" and got[r.page_id].licence in said), r.url
