"""Every registered query of the library runs, and equals its SQL where it has one."""

import pytest

from loomspan import catalog

from .oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLE_SQL:
        compare(df, catalog.ORACLE_SQL[name], sf)
    else:
        assert df.columns and df.count() > 0


def test_page_tiers_of_short_and_odd_pages(spark, tmp_path):
    """Articles about as long as the least one: references count as written, and pages without an article, title, language or html have a tier."""
    page = '<html lang="en"><title>{0}</title><body><article><h1>{0}</h1><p><b>{0}<br></article><footer>foot</footer></body></html>'
    short = [page.format(x) for x in ("Von. It.&amp;", "Von. I.&amp;&am", "Von. It is.&quot;&lt;", "Von. It", "Von. It is some", "Von. It is 　so")]
    words = "words enough for any reader of pages"
    odd = [None, "", "<p>thin", f"<article>{words}</article>", f'<html lang="de"><article>{words}', f"<title>t</title><article>{words}</article><article>{words}</article>", f"<title>t</title><article></article><main>{words}</main>"]
    spark.createDataFrame([(i, f"https://h.org/{i}", h) for i, h in enumerate(short + odd)], "page_id long, url string, html string").toPandas().to_parquet(tmp_path / "pages.parquet")
    compare(catalog.QUERIES["page_tiers"](spark, str(tmp_path)), catalog.ORACLE_SQL["page_tiers"], str(tmp_path))
