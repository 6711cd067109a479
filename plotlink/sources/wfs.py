"""Feature services as a Spark data source: one partition a tile of the box, pages read in the task."""

from __future__ import annotations

import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from plotlink.functions.crs import urn
from plotlink.params import DEFAULTS

RETRIES = 2
PAGE_SCHEMA = "tile int, page_no int, url string, content binary"


def append_query(base: str, params: dict[str, str]) -> str:
    """Parameters that the URL already has, letter case aside, are not set again."""
    base = base.strip()
    have = {k.lower() for k, _ in urllib.parse.parse_qsl(base.partition("?")[2], keep_blank_values=True)}
    more = urllib.parse.urlencode({k: v for k, v in params.items() if k.lower() not in have})
    if not more:
        return base
    glue = "?" if "?" not in base else "" if base[-1] in "?&" else "&"
    return base + glue + more


def feature_url(base: str, type_name: str, crs: str, box: tuple[float, float, float, float], *, version: str = "2.0.0", count: int = DEFAULTS.page_size, start: int = 0, swap_axes: bool = False) -> str:
    x0, y0, x1, y1 = (f"{v:.3f}" for v in box)
    corners = ",".join((y0, x0, y1, x1) if swap_axes else (x0, y0, x1, y1))
    q = {"SERVICE": "WFS", "REQUEST": "GetFeature", "VERSION": version}
    if version.startswith("2"):
        q |= {"TYPENAMES": type_name, "SRSNAME": urn(crs), "BBOX": f"{corners},{urn(crs)}", "COUNT": str(count)} | ({"STARTINDEX": str(start)} if start else {})
    else:
        q |= {"TYPENAME": type_name, "SRSNAME": crs, "BBOX": f"{corners},{crs}", "MAXFEATURES": str(count)}
    return append_query(base, q)


def fetch(url: str, timeout: float = 60) -> bytes:
    """Timeouts are tried again; other errors carry a short, tag-free piece of the answer."""
    for attempt in range(RETRIES + 1):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:
                return r.read()
        except TimeoutError:
            if attempt == RETRIES:
                raise
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"HTTP {e.code}: {snippet(e.read().decode(errors='replace'))}") from e
    raise AssertionError


def snippet(body: str, most: int = 300) -> str:
    import re

    return " ".join(re.sub("<[^>]+>", " ", body).split())[:most]


@dataclass
class Tile(InputPartition):
    number: int
    box: tuple[float, float, float, float]


class WfsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.o = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[Tile]:
        x0, y0, x1, y1 = map(float, self.o["bbox"].split(","))
        n = int(self.o.get("tiles", 1))
        dx, dy = (x1 - x0) / n, (y1 - y0) / n
        return [Tile(i * n + j, (x0 + i * dx, y0 + j * dy, x0 + (i + 1) * dx, y0 + (j + 1) * dy)) for i in range(n) for j in range(n)]

    def read(self, partition: Tile) -> Iterator[tuple]:
        from plotlink.sources.gml import parse_page

        size, version = int(self.o.get("pagesize", DEFAULTS.page_size)), self.o.get("version", "2.0.0")
        seen: set[str] = set()
        start = page = 0
        while True:
            url = feature_url(self.o["path"] if "path" in self.o else self.o["url"], self.o["typename"], self.o["crs"], partition.box, version=version, count=size, start=start, swap_axes=self.o.get("swapaxes") == "true")
            content = fetch(url)
            features, raw = parse_page(content, self.o.get("idattribute"), False)
            yield (partition.number, page, url, content)
            names = {f["id"] or f["gml_id"] or f"{page}-{f['position']}" for f in features}
            if raw < size or not version.startswith("2") or not names - seen or len(seen | names) >= DEFAULTS.max_features:
                return
            seen |= names
            start, page = start + raw, page + 1


class WfsDataSource(DataSource):
    """format("wfs") with url, typeName, crs, bbox and, if wanted, tiles, pageSize, version, swapAxes, idAttribute."""

    @classmethod
    def name(cls) -> str:
        return "wfs"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema: StructType) -> WfsReader:
        return WfsReader(self.options)


def capabilities(base: str) -> str:
    """The capabilities text of a service; see functions.text.has_feature_type."""
    return fetch(append_query(base, {"SERVICE": "WFS", "REQUEST": "GetCapabilities"})).decode(errors="replace")
