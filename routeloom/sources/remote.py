"""Remote search, metadata and checkouts, with the network behind a function that can be replaced."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE, MAX_PAGES = 100, 10
API = "https://api.github.com"
Fetch = Callable[[str, dict[str, str]], tuple[int, dict[str, str], bytes]]


def fetched(url: str, headers: dict[str, str]) -> tuple[int, dict[str, str], bytes]:
    """Status, lower-case headers and body of a GET."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=30) as response:
            return response.status, {k.lower(): v for k, v in response.headers.items()}, response.read()
    except urllib.error.HTTPError as error:
        return error.code, {k.lower(): v for k, v in error.headers.items()}, error.read()


def auth_header() -> dict[str, str]:
    """The bearer header if the environment has a token; it is never logged."""
    token = os.environ.get("GITHUB_TOKEN")
    return {"Authorization": f"Bearer {token}"} if token else {}


def delay_until(reset: int, now: float) -> int:
    return max(1, reset - int(now) + 2)


def get_json(url: str, fetch: Fetch = fetched, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time) -> dict:
    """The JSON object at ``url``; waits where the rate limit says so, other failures are errors."""
    while True:
        status, headers, body = fetch(url, {"Accept": "application/vnd.github+json", **auth_header()})
        if status in (403, 429):
            sleep(delay_until(int(headers.get("x-ratelimit-reset") or 0), now()))
            continue
        if status >= 400:
            raise OSError(f"{status} from {url}")
        if headers.get("x-ratelimit-remaining") == "0" and headers.get("x-ratelimit-reset"):
            sleep(delay_until(int(headers["x-ratelimit-reset"]), now()))
        return json.loads(body)


def search(query: str, limit: int, get: Callable[[str], dict] = get_json) -> Iterator[dict]:
    """Up to ``limit`` items of a search, most recently updated first: at most MAX_PAGES pages, until a short one."""
    left = limit
    for page in range(1, MAX_PAGES + 1):
        size = min(PAGE, left)
        if size <= 0:
            return
        options = {"q": query, "sort": "updated", "order": "desc", "per_page": size, "page": page}
        items = get(f"{API}/search/repositories?{urllib.parse.urlencode(options)}").get("items") or []
        yield from (x for x in items if isinstance(x, dict))
        left -= len(items)
        if len(items) < size:
            return


def searched(queries: DataFrame, limit: int, find: Callable[[str, int], Iterator[dict]] = search) -> DataFrame:
    """query, ord, item_order, item (JSON) of every query (ord, query), one query after another in each task."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for order, query in zip(batch.column("ord").to_pylist(), batch.column("query").to_pylist()):
                items = [json.dumps(x) for x in find(query, limit)]
                n = len(items)
                yield pa.RecordBatch.from_arrays([pa.array([query] * n, pa.string()), pa.array([order] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(items, pa.string())], ["query", "ord", "item_order", "item"])

    return queries.select(F.col("ord").cast("long"), "query").mapInArrow(run, "query string, ord long, item_order long, item string")


def metadata(owner: str, name: str, get: Callable[[str], dict] = get_json) -> dict:
    """What the host says of a repository; nothing if it can't be had."""
    try:
        found = get(f"{API}/repos/{owner}/{name}")
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def git(command: list[str], folder: str | None = None) -> str:
    return subprocess.run(["git", *command], cwd=folder, check=True, capture_output=True, text=True).stdout.strip()


def checkout(url: str, folder: str, run: Callable[..., str] = git) -> str:
    """A shallow checkout of one branch without tags, brought up to date if it is there; the commit that it is at."""
    if (Path(folder) / ".git").exists():
        run(["fetch", "--depth", "1", "origin"], folder)
        run(["checkout", "--detach", "FETCH_HEAD"], folder)
    else:
        shutil.rmtree(folder, ignore_errors=True)
        run(["clone", "--depth", "1", "--single-branch", "--no-tags", url, folder])
    return run(["rev-parse", "HEAD"], folder)


def failure_message(error: subprocess.CalledProcessError) -> str:
    """Command and what it said: its error output, else its output, else the exit code."""
    said = (error.stderr or "").strip() or (error.stdout or "").strip() or f"exit code {error.returncode}"
    return f"{' '.join(map(str, error.cmd))}: {said}"


def clean_up(folder: str, root: str) -> bool:
    """Remove a checkout; nothing outside ``root`` is touched."""
    own = Path(folder).resolve()
    if not own.is_relative_to(Path(root).resolve()) or not own.exists():
        return False
    shutil.rmtree(own)
    return True
