"""Directories behind HTTP: crawling index pages, build manifests, downloads.  Planning work on the driver.

``fetch`` (url -> text, or None where there is nothing) stands for the network, so that all of it runs without.
"""

from __future__ import annotations

import os
import re
import ssl
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from pathlib import Path
from urllib.parse import urljoin, urlparse

from ..functions import ci, urls
from ..functions.config import TargetConfig

MOST_REQUESTS, THREADS, DOWNLOADS = 2500, 4, 5
#: Folders that are never entered.
SKIPPED = ("/etc/", "/proc/", "/sys/")
Fetch = Callable[[str], str | None]


class ListingError(RuntimeError):
    """Nothing could be listed: the run ends, unlike for a source that cannot be read."""


def http_fetch(auth: tuple[str, str] | None = None, ca_file: str | None = None, verify: bool = True, timeout: float = 30) -> Fetch:
    """Fetch with an optional header and certificate bundle; a missing page is None, proxies come from the environment."""
    context = ssl.create_default_context(cafile=ca_file)
    if not verify:
        context.check_hostname, context.verify_mode = False, ssl.CERT_NONE

    def fetch(url: str) -> str | None:
        request = urllib.request.Request(url, headers=dict([auth]) if auth else {})
        try:
            with urllib.request.urlopen(request, timeout=timeout, context=context) as reply:
                return reply.read().decode(errors="replace")
        except urllib.error.HTTPError as problem:
            if problem.code == 404:
                return None
            raise

    return fetch


def index_links(base: str, page: str) -> list[str]:
    """The links of an index page, resolved, up to its footer."""
    return [urljoin(base, x) for x in re.findall(urls.INDEX_LINK, page.split(urls.INDEX_END, 1)[0])]


def directory_of(url: str) -> str | None:
    path = urlparse(url).path
    return url if path.endswith("/") else url[: -len("index.html")] if path.endswith("/index.html") else None


def crawl(base: str, fetch: Fetch, most_requests: int = MOST_REQUESTS, threads: int = THREADS) -> Iterator[str]:
    """The files under an index page; links must lead deeper, and each page is read once."""
    seen, asked = {base}, 0
    with ThreadPoolExecutor(threads) as pool:
        open_ = {pool.submit(fetch, base): base}
        while open_:
            done, _ = wait(open_, return_when=FIRST_COMPLETED)
            for job in done:
                at = open_.pop(job)
                page = job.result()
                if page is None and at == base:
                    raise ListingError(f"{base}: no index page")
                for link in index_links(at, page or ""):
                    link = link.split("#")[0]
                    if link in seen or not link.startswith(base) or len(link) <= len(at) or any(s in link for s in SKIPPED):
                        continue
                    seen.add(link)
                    if (folder := directory_of(link)) is None:
                        yield link
                    elif asked < most_requests and (folder == link or folder not in seen):
                        seen.add(folder)
                        asked += 1
                        open_[pool.submit(fetch, folder)] = folder


def build_sources(log_url: str, manifest: str | None, fetch: Fetch, config: TargetConfig | None = None) -> list[str]:
    """The files of a build: of its manifest if that is there, else of its index pages; none at all is an error."""
    text = fetch(manifest) if manifest else None
    found = ci.flatten_manifest(text, log_url) if text else list(crawl(log_url, fetch))
    config = config or TargetConfig()
    kept = [u for u in found if wanted(u[len(log_url) :], config)]
    if not kept:
        raise ListingError(f"{log_url}: no source")
    return kept


def wanted(relative: str, config: TargetConfig) -> bool:
    from ..functions import patterns as P

    bare = re.sub(r"(\.gz)+\Z", "", relative)
    excludes = [*config.excludes, *(P.EXCLUDED_PATHS if config.default_excludes else ())]
    return (not config.includes or any(re.search(p, bare) for p in config.includes)) and not any(re.search(p, bare) for p in excludes)


def job_history(job: str, storage: tuple[str, str], page_of: Fetch, site: str) -> Iterator[dict]:
    """All builds of a job, page by page; the last id leads to the next page, an empty page ends it."""
    import json

    after = None
    while True:
        url = f"{site}/job-history/{storage[0]}/{storage[1]}/pr-logs/directory/{job}" + (f"?buildId={after}" if after else "")
        found = re.search(ci.JOB_HISTORY.replace("(?m)", ""), page_of(url) or "", re.M)
        if not found:
            raise ListingError(f"{url}: no builds in the page")
        builds = json.loads(found[1])
        if not builds:
            return
        yield from builds
        after = builds[-1]["ID"]


def download(sources: list[str], base: str, to: str, fetch_bytes: Callable[[str], bytes], threads: int = DOWNLOADS) -> list[str]:
    """Copy remote sources below a folder, under their relative names."""

    def one(url: str) -> str:
        where = Path(to) / url[len(base) :].lstrip("/")
        if not os.path.abspath(where).startswith(os.path.abspath(to) + os.sep):
            raise ValueError(f"{url}: leaves the folder")
        where.parent.mkdir(parents=True, exist_ok=True)
        where.write_bytes(fetch_bytes(url))
        return str(where)

    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(one, sources))
