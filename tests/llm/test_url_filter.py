import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm.queries import URL_RULES
from marketloom.llm.url_filter import UrlTrie, filter_urls, split_url

part = st.sampled_from(["com", "example", "net", "a", ""])
hosts = st.lists(part, max_size=3).map(".".join)
paths = st.lists(st.sampled_from(["en", "e", "7", ""]), max_size=3).map(lambda x: "/" + "/".join(x) if x else "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["allow", "block"]), hosts.filter(bool), paths), max_size=6), hosts, paths)
def test_longest_match(rules, host, path):
    fits = [(len(h), len(p), v == "allow", h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    found = UrlTrie(rules).match(host, path)
    assert (found is None) == (not fits)
    if fits:
        want = max(fits)
        assert found == ("allow" if want[2] else "block", want[3])


def test_split():
    assert split_url("HTTP://WWW.Example.com/en/7?x#y") == ("www.example.com", "/en/7")
    assert split_url("x://h#/p") == ("h", "") and split_url("x://h?/p://q") == ("h", "")
    assert split_url(None) == split_url("no scheme/") == ("", "") and split_url("x://É/É") == ("É", "/É")


def test_rows(spark):
    urls = ["http://a.com/en/1", "http://example.com/en/71", "http://x.net/de/", "http://example.net/de/80", "http://b.org/es", None, "nothing", "http://a.com/en/1"]
    rows = spark.createDataFrame([(k, u, "h", "r", None) for k, u in enumerate(urls)], "page_id long, url string, host string, rule string, verdict string")
    found = [(r.rule, r.verdict) for r in filter_urls(rows, URL_RULES).orderBy("page_id").collect()]
    assert found == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/en/", "block")]
    assert filter_urls(rows.limit(0), URL_RULES).count() == 0
    with pytest.raises(ValueError):
        UrlTrie([("maybe", "com", "/")])


def test_many_rules_are_dealt_to_several_tries(spark, monkeypatch):
    from marketloom.llm import url_filter

    urls = ["http://a.com/en/1", "http://example.com/en/71", "http://x.net/de/", "http://example.net/de/80", "http://b.org/es/", None]
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    rules = [*URL_RULES, ("block", "example.com", "/en/7"), ("block", "net", "/de/")]
    once = sorted(map(tuple, filter_urls(rows, rules).collect()))
    monkeypatch.setattr(url_filter, "BLOCK_RULES", 2)
    assert sorted(map(tuple, filter_urls(rows, rules).collect())) == once and once[1][-1] == once[2][-1] == "allow"
