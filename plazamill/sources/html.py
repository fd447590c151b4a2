"""Candidates from raw HTML: structured data, headings, table rows, links. Arrow batches in, rows out."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("jsonld", "heading", "row", "link")
SCHEMA = "page_id long, kind string, position int, title string, url string"
BATCH = 20_000


class _Page(HTMLParser):
    """Collects texts of headings, table rows and links, and JSON-LD blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, str | None]] = []
        self.open: list[list] = []
        self.skip, self.data = 0, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "script" and (a.get("type") or "").lower() == "application/ld+json":
            self.data = []
        elif tag in ("script", "style"):
            self.skip += 1
        elif tag in ("h1", "h2", "h3", "tr", "a"):
            self.open.append([tag, a.get("href"), []])

    def handle_endtag(self, tag):
        if tag == "script" and self.data is not None:
            self.jsonld("".join(self.data))
            self.data = None
        elif tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("h1", "h2", "h3", "tr", "a"):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    _, href, parts = self.open.pop(i)
                    text = " ".join(" ".join(parts).split())
                    if text:
                        self.found.append(({"tr": "row", "a": "link"}.get(tag, "heading"), text, href))
                    break

    def handle_data(self, data):
        if self.data is not None:
            self.data.append(data)
        elif not self.skip:
            for x in self.open:
                x[2].append(data)

    def jsonld(self, raw: str):
        try:
            todo = [json.loads(raw)]
        except ValueError:
            return
        while todo:
            x = todo.pop()
            if isinstance(x, list):
                todo += x
            elif isinstance(x, dict):
                if x.get("@type") == "JobPosting" and x.get("title"):
                    self.found.append(("jsonld", str(x["title"]), x.get("url")))
                todo += [v for v in x.values() if isinstance(v, (dict, list))]


def candidates(pages: DataFrame) -> DataFrame:
    """page_id, kind, position, title, url; a candidate that repeats its page's url (else title) comes once. Null or
    broken HTML gives what could be read."""

    def run(batches):
        for b in batches:
            rows = []
            for page, html in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist()):
                p = _Page()
                p.feed(html or "")
                seen = set()
                for kind, title, url in p.found:
                    if (key := (kind, url or title)) not in seen:
                        seen.add(key)
                        rows.append((page, kind, len(seen) - 1, title, url))
                if len(rows) >= BATCH:
                    yield batch(rows)
                    rows = []
            yield batch(rows)

    def batch(rows):
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["page_id", "kind", "position", "title", "url"])

    return pages.select("page_id", "html").mapInArrow(run, SCHEMA)
