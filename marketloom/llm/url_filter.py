"""URL filters: a trie over reversed host labels, then path segments, with longest-match precedence."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from marketloom.llm.text import arrow_map, share

#: Rules of a trie; more are dealt to several, which tasks hold one after the other. One of so many takes some 100 MB.
BLOCK_RULES = 500_000


def split_url(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path; both empty without a `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cuts = [i for i in (rest.find("?"), rest.find("#")) if i >= 0]
    rest = rest[: min(cuts)] if cuts else rest
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), path


class UrlTrie:
    """Each node is [children by label, path node]; a path node is [children by whole segment, rules ending inside a segment].

    A rule's host fits itself and its subdomains, its path is a prefix by characters: whole
    segments lead down the trie, and what follows the last slash is kept in the node as a partial segment.
    Of the rules that fit, the one with the longest host, then the longest path, wins; allow wins an exact tie.
    """

    def __init__(self, rules: list[tuple[str, str, str]]) -> None:
        self.root: list = [{}, None]
        for verdict, host, path in sorted(rules, key=lambda r: r[0] != "block"):  # allow is put last and so wins a tie
            if verdict not in ("allow", "block"):
                raise ValueError("a verdict is 'allow' or 'block'")
            host, node = host.lower(), self.root
            for label in reversed(host.split(".")) if host else ():
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, {}]
            at, (*whole, partial) = node[1], path.split("/")
            for segment in whole:
                at = at[0].setdefault(segment, [{}, {}])
            at[1][partial] = (verdict, host + path, (len(host), len(path), verdict == "allow"))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        found = self.ranked(host, path)
        return found and found[:2]

    def ranked(self, host: str, path: str) -> tuple[str, str, tuple] | None:
        """Verdict, rule and its rank among rules that fit."""
        best, node = None, self.root
        trail = [node]
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            trail.append(node)
        segments = path.split("/")
        for node in reversed(trail):  # from the longest host
            at, found = node[1], None
            for k, segment in enumerate(segments):
                if at is None:
                    break
                if at[1]:
                    for n in range(len(segment), -1, -1):
                        if segment[:n] in at[1]:
                            found = at[1][segment[:n]]
                            break
                at = at[0].get(segment) if k < len(segments) - 1 else None
            if found:
                best = found
                break
        return best


SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; `default` is the verdict where no rule fits.

    A null url has an empty host and path and gets the default verdict. Rows are judged alone: repeated rows
    and null ids give a row each, an empty table gives none, other columns are not read. A very long url is matched whole; of rules
    with one host and path, allow wins. Tries of BLOCK_RULES rules each are broadcast and asked one after the other; the longest
    match of all wins, so their number doesn't count. There is no shuffle.
    """
    shared = [share(pages.sparkSession, UrlTrie(rules[k : k + BLOCK_RULES])) for k in range(0, max(1, len(rules)), BLOCK_RULES)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = shared[0]() if len(shared) == 1 else None
        for batch in batches:
            split = [split_url(url) for url in batch.column(1).to_pylist()]
            best: list[tuple[str, str, tuple] | None] = [None] * len(split)
            for trie in [only] if only else (block() for block in shared):
                for k, (host, path) in enumerate(split):
                    found = trie.ranked(host, path)
                    if found and (best[k] is None or found[2] > best[k][2]):
                        best[k] = found
            columns = [[x[0] for x in split], [x[1] for x in split], [x and x[1] for x in best], [x[0] if x else default for x in best]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in columns)], ["page_id", "host", "path", "rule", "verdict"])

    rows = pages.selectExpr(f"cast(`{id_column}` as long) as page_id", f"cast(`{url_column}` as string) as url")
    return arrow_map(rows, judge, SCHEMA)
