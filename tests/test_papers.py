"""Recorded answers of paper archives: odd records have a defined result."""

import datetime as dt

from corpuscle.sources import papers

FEED = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom"><title>ArXiv Query</title>
<entry><id> http://arxiv.org/abs/1 </id><title>Two
lines</title><author><name> Ada </name></author><author><name/></author><author/><summary> An &lt;abstract&gt; &amp; more. </summary><published>2020-05-06T00:00:00Z</published>
<category term="cs.AI"/><category term=""/><link title="doi" href="d"/><link title="pdf" href="p1"/><link title="pdf" href="p2"/></entry>
<entry/>
<entry><id>2</id><published>soon</published><extra>ignored</extra></entry>
</feed>"""


def test_atom_entries(spark, tmp_path):
    (tmp_path / "good.xml").write_text(FEED)
    rows = {r["source_url"]: r.asDict() for r in papers.read_atom(spark, str(tmp_path)).collect()}
    one = rows["http://arxiv.org/abs/1"]
    assert (one["title"], one["authors"], one["abstract"]) == ("Two lines", ["Ada"], "An <abstract> & more.")
    assert (one["published_date"], one["categories"], one["pdf_url"], one["malformed"]) == (dt.date(2020, 5, 6), ["cs.AI"], "p1", False)
    assert rows["2"] == {"source_url": "2", "title": "Untitled", "authors": [], "abstract": "", "published_date": None, "categories": [], "pdf_url": "", "malformed": False}
    assert "" in rows and rows[""]["title"] == "Untitled"


def test_a_broken_feed_is_marked(spark, tmp_path):
    (tmp_path / "bad.xml").write_text("<feed><entry><id>1</id></entry><entry><id>2</title></entry></feed>")
    rows = papers.read_atom(spark, str(tmp_path)).collect()
    assert any(r["malformed"] for r in rows) and not any(r["source_url"] == "2" and not r["malformed"] for r in rows)


def test_article_summaries(spark):
    answers = [
        '{"result": {"uids": ["1", "2", "3"], "1": {"title": "A", "authors": [{"name": "X"}, {"name": ""}, {}], "pubdate": " 2023 Dec 5", "fulljournalname": "J", "elocationid": "doi: 1"}, "2": {"error": "no"}, "3": {"pubdate": "Spring"}}}',
        "not json",
        '{"other": 1}',
        None,
    ]
    got = {r["pmid"]: tuple(r)[1:] for r in papers.article_summaries(spark.createDataFrame([(a,) for a in answers], "body string")).collect()}
    assert got == {
        "1": ("A", ["X"], "https://pubmed.ncbi.nlm.nih.gov/1/", dt.date(2023, 12, 5), "J", "doi: 1"),
        "3": ("Untitled", [], "https://pubmed.ncbi.nlm.nih.gov/3/", None, "", ""),
    }


def test_abstract_records(spark, tmp_path):
    text = "heading before any record\nPMID: 11 [x]\n\n  First line \nDOI: 10.1\n DOI: kept\nsecond\nPMID:12\nPMID: none\nlost\nPMID: 13\r\nonly\r\n"
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("PMID: 20\nat the start\n")
    got = sorted(tuple(r) for r in papers.read_abstracts(spark, str(tmp_path)).collect())
    assert got == [("11", "First line\nDOI: kept\nsecond"), ("13", "only"), ("20", "at the start")]
