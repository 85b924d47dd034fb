"""A read-only page over stored events (K9, E4): counts, busiest sources, a filter."""

from __future__ import annotations

import argparse
import html
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlencode, urlparse

from pyspark.sql import DataFrame, SparkSession

from weir.operators.explore import page
from weir.sources.jsonl import event_json, read_events

COLUMNS = ("timestamp", "observer_vendor", "network_src_ip", "network_dst_ip", "event_action", "event_outcome", "parse_status")
ROWS = 500


def render(events: DataFrame, query: str = "", number: int = 1, rows: int = ROWS) -> str:
    """The page; its table shows the matching events in the order they are stored, `rows` at
    a time, with links to the matches before and after. A number out of range shows the
    nearest page."""
    e = html.escape
    p = page(events, query)
    counts = p["summary"].first().asDict()
    tops = p["top_sources"].collect()
    found = p["rows"].count()
    pages = max(1, -(-found // rows))
    number = min(max(1, number), pages)
    body = p["rows"].orderBy("source_file", "seq").offset((number - 1) * rows).limit(rows).select(*COLUMNS).collect()
    cells = "".join("<tr>" + "".join(f"<td>{e(str(v or ''))}</td>" for v in r) + "</tr>" for r in body)
    link = lambda n, text: f'<a href="?{e(urlencode({"q": query, "page": n}))}">{text}</a> ' if 1 <= n <= pages and n != number else ""
    return (
        "<!doctype html><meta charset=utf-8><title>Events</title>"
        + "<ul>" + "".join(f"<li>{e(k)}: {v}</li>" for k, v in counts.items()) + "</ul>"
        + "<ol>" + "".join(f"<li>{e(r.src_ip)}: {r.events}</li>" for r in tops) + "</ol>"
        + f"<form><input name=q value=\"{e(query, quote=True)}\"><button>Filter</button></form>"
        + f"<p>{found} matching, page {number} of {pages} " + link(1, "first") + link(number - 1, "previous") + link(number + 1, "next") + link(pages, "last") + "</p>"
        + "<table><tr>" + "".join(f"<th>{e(c)}</th>" for c in COLUMNS) + f"</tr>{cells}</table>"
    )


def server(spark: SparkSession, target: str, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            """Quiet."""

        def do_GET(self):
            url = urlparse(self.path)
            events = read_events(spark, f"{target}/events.jsonl")
            if url.path == "/":
                asked = parse_qs(url.query)
                number = asked.get("page", ["1"])[0]
                kind, chunks = "text/html; charset=utf-8", [render(events, asked.get("q", [""])[0], int(number) if number.isdecimal() else 1)]
            elif url.path in ("/events.jsonl", "/download/events.jsonl"):
                kind, chunks = "application/x-ndjson", (r.j + "\n" for r in events.select(event_json().alias("j")).toLocalIterator())
            else:
                self.send_error(404)
                return
            self.send_response(200)
            self.send_header("Content-Type", kind)
            self.end_headers()
            for c in chunks:
                self.wfile.write(c.encode())

    return ThreadingHTTPServer((host, port), Handler)


def main(argv: list[str] | None = None) -> None:
    from weir.plans.batch import CONFIGS, parser_options, run

    p = argparse.ArgumentParser(description="View stored events")
    p.add_argument("target")
    p.add_argument("--rebuild", metavar="SOURCE", help="run the batch plan over this folder first")
    p.add_argument("--configs", default=CONFIGS, help="folder of config-driven parsers for --rebuild")
    p.add_argument("--mappings", help="folder of mappings for --rebuild")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.rebuild:
        run(spark, a.rebuild, a.target, ordered=True, **parser_options(a.configs, a.mappings))
    s = server(spark, a.target)
    print(f"http://{s.server_address[0]}:{s.server_address[1]}/", flush=True)
    s.serve_forever()


if __name__ == "__main__":
    main()
