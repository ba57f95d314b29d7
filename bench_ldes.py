"""Time the event stream client: members of pages that a local server gives out, batch and stream, as one line of JSON.

Arguments: members (100000), members a page (250). The server is a process of its own.
"""

from __future__ import annotations

import http.server
import json
import multiprocessing
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.sources.ldes import LdesDataSource
from tessera.vocabulary import RDF_TYPE, TREE, XSD

EX = "https://example.org/ns#"


def page(base: str, n: int, pages: int, size: int) -> str:
    """Page n: its members, six statements each, and a relation to the page after it."""
    lines = [f"<{base}/{n}> <{RDF_TYPE}> <{TREE}Node> ."]
    if n + 1 < pages:
        lines += [f"<{base}/{n}> <{TREE}relation> _:r .", f"_:r <{TREE}node> <{base}/{n + 1}> ."]
    for i in range(n * size, (n + 1) * size):
        m = f"<{base}/member/{i}>"
        lines += [
            f"<{base}/stream> <{TREE}member> {m} .", f"{m} <{RDF_TYPE}> <{EX}Measure> .", f'{m} <{EX}at> "2024-01-01T00:00:{i % 60:02d}Z"^^<{XSD}dateTime> .',
            f"{m} <{EX}of> <{EX}thing/{i % 97}> .", f"{m} <{EX}result> _:b{i} .", f'_:b{i} <{EX}value> "{i / 7:.4f}"^^<{XSD}double> .', f'_:b{i} <{EX}unit> "degC" .',
        ]
    return "\n".join(lines) + "\n"


def serve(pipe, pages: int, size: int) -> None:
    kept: dict[int, bytes] = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_GET(self) -> None:
            n = int(self.path.rpartition("/")[2])
            if n not in kept:
                kept[n] = page(f"http://127.0.0.1:{self.server.server_port}", n, pages, size).encode()
            self.send_response(200)
            for k, v in {"Content-Type": "application/n-quads", "Cache-Control": "immutable", "Content-Length": str(len(kept[n]))}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(kept[n])

        def log_message(self, *_) -> None:
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    pipe.send(server.server_port)
    server.serve_forever()


def main() -> None:
    members, size = (int(x) for x in (sys.argv[1:] + ["100000", "250"][len(sys.argv) - 1 :]))
    here, there = multiprocessing.Pipe()
    server = multiprocessing.Process(target=serve, args=(there, members // size, size), daemon=True)
    server.start()
    url = f"http://127.0.0.1:{here.recv()}/0"
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.dataSource.register(LdesDataSource)
    began = time.perf_counter()
    got = spark.read.format("ldes").option("urls", url).load().agg(F.count_distinct("member_id"), F.count("*")).first()
    batch = time.perf_counter() - began
    assert got[0] == members
    began, counted = time.perf_counter(), []
    stream = spark.readStream.format("ldes").option("urls", url).option("pages-per-batch", "100").load()
    query = stream.writeStream.foreachBatch(lambda df, _: counted.append(df.agg(F.count_distinct("member_id")).first()[0])).option("checkpointLocation", tempfile.mkdtemp()).start()
    while sum(counted) < members and query.isActive:
        time.sleep(0.2)
    streamed = time.perf_counter() - began
    query.stop()
    assert sum(counted) == members
    print(json.dumps({"metric": "members_per_second", "members": members, "per_page": size, "batch": round(members / batch), "stream": round(members / streamed), "statements": got[1]}))
    spark.stop()
    server.terminate()


if __name__ == "__main__":
    main()
