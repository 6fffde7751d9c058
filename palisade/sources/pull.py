"""Remote feeds: plain downloads, and a MISP pull whose publish window is bisected into slices that executors page through."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import os
import re
import shutil
import tarfile
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema as S

MAX_STEPS, MAX_PAGES = 1_000_000, 100_000


def window_start(token: str, now: int) -> int:
    """Nd, Nh or Nm back from now; digits alone are Unix seconds."""
    m = re.fullmatch(r"([0-9]{1,12})([dhm]?)", token)
    if not m:
        raise S.EngineError(S.EINVAL, f"no window: {token}")
    return int(m[1]) if not m[2] else now - int(m[1]) * {"d": 86400, "h": 3600, "m": 60}[m[2]]


def next_cursor(newest: int | None, since: int, now: int, before: int | None) -> int | None:
    """Where the next pull starts; an empty pull changes nothing."""
    return before if newest is None else min(max(newest, since), now)


def bisect(lo: int, hi: int, over: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
    """Slices of [lo, hi], the oldest first, halved while one is over its limit, to one second at least."""
    todo, steps = [(lo, hi)], 0
    while todo:
        steps += 1
        if steps > MAX_STEPS:
            raise S.EngineError(S.EIO, "too many slices")
        a, b = todo.pop()
        if b > a and over(a, b):
            mid = a + (b - a) // 2
            todo += [(mid + 1, b), (a, mid)]
        else:
            yield a, b


def bisect_counts(stamps: DataFrame, lo: int, hi: int, most: int) -> list[tuple[int, int]]:
    """The slices of bisect() with at most so many rows each, for a table (s: Unix seconds, n: rows). One job for each level of halving counts all open slices."""
    todo, done = [(lo, hi)], []
    while todo:
        begins = F.array(*(F.lit(a).cast("bigint") for a, _ in todo))
        ends = F.array(*(F.lit(b).cast("bigint") for _, b in todo))
        at = F.size(F.filter(begins, lambda x: x <= F.col("s"))) - 1
        counted = stamps.withColumn("at", at).filter((F.col("at") >= 0) & (F.col("s") <= F.get(ends, F.col("at")))).groupBy("at").agg(F.sum("n").alias("n")).collect()
        n = {r["at"]: r["n"] for r in counted}
        over = [b > a and n.get(k, 0) > most for k, (a, b) in enumerate(todo)]
        done += [x for x, o in zip(todo, over, strict=True) if not o]
        todo = [x for (a, b), o in zip(todo, over, strict=True) if o for x in ((a, a + (b - a) // 2), (a + (b - a) // 2 + 1, b))]
    return sorted(done)


def post(url: str, key: str, body: dict) -> list[dict]:
    request = urllib.request.Request(url.rstrip("/") + "/attributes/restSearch", json.dumps(body).encode(), {"Authorization": key, "Content-Type": "application/json", "Accept": "application/json"})
    with urllib.request.urlopen(request, timeout=120) as answer:
        found = json.load(answer)
    return (found.get("response") or found).get("Attribute") or []


def download(url: str, dest: str, key: str | None = None, body: dict | None = None) -> None:
    """A GET, or a POST of a body, to a new name, then a rename."""
    headers = {"Content-Type": "application/json", "Accept": "application/json"} if body is not None else {}
    request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), headers | ({"Authorization": key} if key else {}))
    with urllib.request.urlopen(request, timeout=120) as answer, open(dest + ".new", "wb") as f:
        while part := answer.read(1 << 20):
            f.write(part)
    os.replace(dest + ".new", dest)


def download_misp(feed: dict) -> None:
    """One page of a MISP search over the feed's window into its file."""
    if not all(feed.get(k) for k in ("url", "key", "dest")):
        raise S.EngineError(S.EINVAL, "a misp feed needs url, key and dest")
    download(feed["url"].rstrip("/") + "/attributes/restSearch", feed["dest"], feed["key"], {"returnFormat": "json", "last": feed.get("since", "7d"), "to_ids": 1, "limit": 10_000})


def _authorised(url: str, user: str, password: str) -> urllib.request.Request:
    return urllib.request.Request(url, headers={"Authorization": "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()})


def download_editions(geo: dict) -> list[str]:
    """Databases of places, as a configuration's geoip names them (base_url, account_id, license_key, editions, dest_dir): those whose
    checksum has changed are fetched as archives and their .mmdb put in place. Returns the editions fetched; without an account, none."""
    user, password = geo.get("account_id"), geo.get("license_key")
    if not user and not password:
        return []
    if not (user and password and geo.get("editions") and geo.get("base_url")):
        raise S.EngineError(S.EINVAL, "geoip needs base_url, account_id, license_key and editions")
    folder, fetched = geo.get("dest_dir", "out"), []
    os.makedirs(folder, exist_ok=True)
    for edition in geo["editions"]:
        place, mark = (os.path.join(folder, f"{edition}.{end}") for end in ("mmdb", "sha256"))
        get = lambda suffix, e=edition: urllib.request.urlopen(_authorised(f"{geo['base_url'].rstrip('/')}/{e}/download?suffix={suffix}", user, password), timeout=120)
        with get("tar.gz.sha256") as answer:
            wanted = answer.read().decode().split()[0]
        if os.path.exists(place) and os.path.exists(mark) and open(mark).read().strip() == wanted:
            continue
        with get("tar.gz") as answer:
            data = answer.read()
        if hashlib.sha256(data).hexdigest() != wanted:
            raise S.EngineError(S.ECHECKSUM, f"the archive of {edition}")
        with tarfile.open(fileobj=io.BytesIO(data)) as archive:
            member = next((m for m in archive if m.isfile() and m.name.endswith(".mmdb")), None)
            if member is None:
                raise S.EngineError(S.EFORMAT, f"the archive of {edition} has no .mmdb")
            with open(place + ".new", "wb") as f:
                shutil.copyfileobj(archive.extractfile(member), f)
        os.replace(place + ".new", place)
        with open(mark, "w") as f:
            f.write(wanted + "\n")
        fetched.append(edition)
    return fetched


class _Slice(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class MispReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.key = options["url"], options.get("key", "")
        now = int(options.get("now") or time.time())
        self.lo, self.hi = window_start(options.get("since", "7d"), now), now
        self.page_size = min(10_000, int(options.get("page_size", 10_000)))
        self.slice_rows = min(10_000_000, int(options.get("slice_rows", 10 * self.page_size)))

    def _body(self, lo: int, hi: int, limit: int, page: int) -> dict:
        return {"returnFormat": "json", "to_ids": 1, "last": [str(lo), str(hi)], "limit": limit, "page": page}

    def partitions(self) -> list[InputPartition]:
        over = lambda a, b: bool(post(self.url, self.key, self._body(a, b, 1, self.slice_rows + 1)))
        return [_Slice(a, b) for a, b in bisect(self.lo, self.hi, over)]

    def read(self, partition) -> Iterator[tuple]:
        number = 0
        for page in range(1, MAX_PAGES + 1):
            rows = post(self.url, self.key, self._body(partition.lo, partition.hi, self.page_size, page))
            for row in rows:
                stamp = row.get("timestamp")
                yield partition.lo, number, None if stamp is None else str(stamp), json.dumps({"Attribute": [row]})
                number += 1
            if len(rows) < self.page_size:
                return
        raise S.EngineError(S.EIO, f"the slice from {partition.lo} to {partition.hi} has more than {MAX_PAGES} pages")


class MispSource(DataSource):
    """spark.read.format("misp_pull"): one row for each attribute, as a document that read_misp() takes, with its slice and its number there."""

    @classmethod
    def name(cls) -> str:
        return "misp_pull"

    def schema(self) -> str:
        return "slice bigint, row bigint, timestamp string, value string"

    def reader(self, schema) -> MispReader:
        return MispReader(self.options)
