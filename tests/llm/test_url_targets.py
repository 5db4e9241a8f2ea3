import pytest

from textloom.llm import url_filter

BLOCK = '<link rel=canonical href="http://foo.net/z">'


def link(to):
    return f'<link rel="canonical" href="{to}">'


@pytest.fixture(scope="module")
def verdicts(spark):
    pages = [
        (1, "http://q.com/a/b/c", link("../x")), (2, "http://q.com/a/x", BLOCK),
        (3, "http://q.com/d/e", link("./y")), (4, "http://q.com/d/y", BLOCK),
        (5, "http://q.com/list", '<meta http-equiv=refresh content="0; url=?p=2">'), (6, "http://q.com/list?p=2", BLOCK),
        (7, "http://q.com/t/u", link("page?t=12:30")), (8, "http://q.com/t/page?t=12:30", BLOCK),
        (9, "http://q.com/m", link("?a=1&amp;b=&#50;&#x33;&eacute;&bogus;")), (10, "http://q.com/m?a=1&b=23é&bogus;", BLOCK),
        (11, "http://q.com/n", link("http://q.com/n1") + link("/n2")), (12, "http://q.com/n2", BLOCK),
        (13, "http://q.com/o", '<meta http-equiv="refresh" content="0; url=/o1"><meta http-equiv="refresh" content="1; url=/o2">'), (14, "http://q.com/o2", BLOCK),
        (15, "http://clean.com/", link("/go?u=http://evil.net/x")), (16, "http://clean.com/go?u=http://evil.net/x", None),
        (17, "http://r.com/", link("/go?u=http://fine.com/x")), (18, "http://r.com/go?u=http://fine.com/x", BLOCK),
        (19, "http://q.com/s", link("mailto:a@foo.net")), (20, "http://q.com/v/w", link("../../../top/.")), (21, "http://q.com/top/", BLOCK),
        (22, "http://q.com/w", link("&#xD800;&#1114112;") + link("#part")), (23, "http://q.com/k/", link("..")), (24, "http://q.com/", BLOCK),
    ]
    found = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"))
    return {r.page_id: r.verdict for r in found.collect()}


@pytest.mark.parametrize("page", [1, 3, 5, 7, 9, 11, 13, 17, 20, 23])
def test_alias_is_blocked(verdicts, page):
    assert verdicts[page] == "block"


@pytest.mark.parametrize("page", [15, 16, 19, 22])
def test_no_alias(verdicts, page):
    assert verdicts[page] == "allow"
