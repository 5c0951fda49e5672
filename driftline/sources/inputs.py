"""From what a user names to a content: file, directory, CI build or address.  Planning work on the driver."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from ..functions import urls

_BUILD = re.compile(r"^(.*)/build/([0-9A-Za-z]{32})$")


@dataclass(frozen=True)
class Content:
    """kind is file, directory, ci or prow; where is a path or URL, api the service's address of a build."""

    kind: str
    where: str
    api: str | None = None
    uuid: str | None = None
    job_name: str | None = None

    def __str__(self) -> str:
        return f"{self.kind.capitalize()}({self.where})"


def of_path(path: str) -> Content:
    if os.path.isdir(path):
        return Content("directory", path)
    if os.path.isfile(path):
        return Content("file", path)
    raise FileNotFoundError(path)


def of_url(url: str) -> Content:
    """A build page, then the other CI, then a directory by its slash, else a file."""
    bare = re.sub(r"[?#].*$", "", url)
    if found := _BUILD.match(bare):
        tenant = re.match(r"^(.*?)/t/.*?([^/]+)$", found[1]) if re.search(r"/t/[^/]+$", found[1]) else None
        api = f"{tenant[1]}/api/tenant/{tenant[2]}/" if tenant else f"{found[1]}/api/"
        return Content("ci", url, api, found[2])
    if re.match(rf"^https?://{re.escape(urls.PROW_HOST)}/", url) and (found := re.match(urls.PROW_PATH, bare)):
        return Content("prow", url, None, found[6], found[5])
    return Content("directory" if bare.endswith("/") else "file", url)


def of_input(given: str) -> Content:
    return of_url(given) if given.startswith("http") else of_path(given)


def for_service(content: Content, any_content: bool = False) -> Content:
    """A service takes CI builds only, unless it is told otherwise."""
    if content.kind not in ("ci", "prow") and not any_content:
        raise ValueError(f"{content}: only builds are accepted")
    return content


def baselines(content: Content) -> list[Content]:
    """What a file is compared with when nothing is given: its last rotation."""
    if content.kind == "file" and not content.where.startswith("http"):
        return [of_path(content.where + ".0")]
    raise ValueError(f"{content}: name a baseline")
