"""URL filter: a trie over reversed host labels and path segments, broadcast, longest entry first.

The rule list is the caller's and bounded (``MAX_RULES``), so the trie is
built on the driver and broadcast; pages are judged where they lie, without a
shuffle. Below each host node hangs a trie over whole path segments, and each
of its nodes holds the last, maybe partial, segments of the rules that end there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 1_000_000
ALLOW, BLOCK = "allow", "block"
_HOST_END, _PATH_END = re.compile("[/?#]"), re.compile("[?#]")


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


class Node:
    __slots__ = ("ends", "labels", "segments")

    def __init__(self):
        self.labels: dict[str, Node] = {}
        self.segments: dict[str, Node] = {}
        self.ends: dict[str, Rule] = {}


def build_trie(rules: list[Rule]) -> Node:
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the broadcast trie holds {MAX_RULES} at most")
    root = Node()
    for rule in rules:
        node = root
        for label in reversed(rule.host.split(".")) if rule.host else ():
            node = node.labels.setdefault(label, Node())
        *whole, last = rule.path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        held = node.ends.get(last)
        if held is None or rule.verdict == BLOCK:
            node.ends[last] = rule
    return root


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3:]
    end = m.start() if (m := _HOST_END.search(rest)) else len(rest)
    path = rest[end:]
    if m := _PATH_END.search(path):
        path = path[:m.start()]
    return rest[:end].encode().lower().decode(), path


def longest(root: Node, host: str, path: str) -> Rule | None:
    """The fitting rule of most characters; of equally long ones that of the longer host."""
    best, size = None, (-1, -1)
    node, labels, parts = root, host.split("."), path.split("/")
    for depth in range(len(labels) + 1):
        at = node
        for part in parts:
            for n in range(len(part) + 1) if at.ends else ():
                rule = at.ends.get(part[:n])
                if rule and (own := (len(rule.host) + len(rule.path), len(rule.host))) > size:
                    best, size = rule, own
            if (at := at.segments.get(part)) is None:
                break
        if depth == len(labels) or (node := node.labels.get(labels[-1 - depth])) is None:
            break
    return best


def judge_urls(pages: DataFrame, columns: list[str], rules: list[Rule], url: str = "url", default: str = ALLOW) -> DataFrame:
    """``columns`` of every row, ``host``, ``path``, ``rule`` (host and path of the longest fitting rule) and ``verdict``.

    A rule fits its host and all subdomains, if the path starts with the
    rule's. The longest fitting rule (host and path together) decides, of two
    equally long ones that with the longer host; a block entry wins over an
    equal allow entry. Where no rule fits, ``rule`` is null and the verdict is
    ``default``. A null URL, or one without ``://``, has an empty host and path.
    Repeated rows each give a row; an empty table gives an empty result.
    """
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [split_url(x) for x in b.column(b.num_columns - 1).to_pylist()]
            found = [longest(trie.value, *x) for x in split]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], *(pa.array(x, pa.string()) for x in (
                    [h for h, _ in split], [p for _, p in split],
                    [r and r.host + r.path for r in found], [r.verdict if r else default for r in found]))],
                [*b.schema.names[:-1], "host", "path", "rule", "verdict"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*columns).schema)
    return pages.select(*columns, F.col(url).alias("_url")).mapInArrow(run, fields + "host string, path string, rule string, verdict string")
