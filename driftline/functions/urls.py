"""URLs and names of sources, as columns: kinds, directories, links of index pages, CI addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends the list of an index page, and a link in it.
INDEX_END = "Logs of interest"
INDEX_LINK = '<a href="(?:\\./)*([\\\\/a-zA-Z0-9][^"]+)"'
PROW_HOST = "prow.ci.openshift.org"
ARTIFACTS = '<a href="(http[^"]+)">Artifacts</a>'
PROW_PATH = "^[a-z]+://[^/]+/view/([^/]+)/([^/]+)/pr-logs/pull/([^/]+)/([0-9]+)/([^/]+)/([0-9]*)$"
_BUILD = "^(.*)/build/([0-9A-Za-z]{32})$"


def _bare(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "")


def path_dir(url: Column) -> Column:
    """The directory that a URL names, or null."""
    bare = _bare(url)
    return F.when(bare.endswith("/index.html"), F.substring(bare, F.lit(1), F.length(bare) - 10)).when(bare.endswith("/"), url)


def join(base: Column, link: Column) -> Column:
    """A link of a page at base, resolved (without dot segments)."""
    origin = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", 0)
    path = F.regexp_extract(F.regexp_replace(_bare(base), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]+", ""), "^.*/", 0)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    scheme = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*:", 0)
    link = F.regexp_replace(link, "\\\\", "/")
    return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(origin, link)).otherwise(F.concat(origin, path, link))


def index_links(base: Column, page: Column) -> Column:
    """array<string>: the resolved links of an "Index of" page, up to its footer."""
    body = F.substring_index(page, INDEX_END, 1)
    return F.transform(F.regexp_extract_all(body, F.lit(INDEX_LINK), F.lit(1)), lambda x: join(base, x))


def ci_build(url: Column) -> Column:
    """struct<api, uuid> of a build page, of a tenant (``/t/name/build/id``) or of a site of its own; else null."""
    base, uuid = F.regexp_extract(_bare(url), _BUILD, 1), F.regexp_extract(_bare(url), _BUILD, 2)
    site, tenant = F.regexp_extract(base, "^(.*?)/t/", 1), F.regexp_extract(base, "/t/([^/]+)$", 1)
    api = F.when(tenant != "", F.concat(site, F.lit("/api/tenant/"), tenant, F.lit("/"))).otherwise(F.concat(base, F.lit("/api/")))
    return F.when(uuid != "", F.struct(api.alias("api"), uuid.alias("uuid")))


def prow_build(url: Column) -> Column:
    """struct of a build page of the other CI: storage_type, storage_path, project, pr, job_name, uid; else null."""
    names = ("storage_type", "storage_path", "project", "pr", "job_name", "uid")
    part = lambda i: F.regexp_extract(_bare(url), PROW_PATH, i)
    parts = [part(i + 1).cast("long").alias(n) if n == "pr" else part(i + 1).alias(n) for i, n in enumerate(names)]
    return F.when(_bare(url).rlike(PROW_PATH), F.struct(*parts))


def artifacts_link(page: Column) -> Column:
    return F.nullif(F.regexp_extract(page, ARTIFACTS, 1), F.lit(""))


def content_kind(given: Column) -> Column:
    """What an input is: ci, prow, directory or file by its URL; a path is told apart when it is listed."""
    url = given.rlike("^https?://")
    prow = (F.regexp_extract(given, "^https?://([^/]+)", 1) == PROW_HOST) & prow_build(given).isNotNull()
    return F.when(~url, "path").when(ci_build(given).isNotNull(), "ci").when(prow, "prow").when(_bare(given).endswith("/"), "directory").otherwise("file")


def build_page(api: Column, uuid: Column) -> Column:
    """The page of a build, from its API address."""
    return F.concat(F.replace(F.replace(api, F.lit("/tenant/"), F.lit("/t/")), F.lit("/api"), F.lit("")), F.lit("build/"), uuid)


def content_id(kind: Column, where: Column) -> Column:
    """The name of a content in catalogs: ``File(...)``, ``Directory(...)`` and so on."""
    return F.concat(F.initcap(kind), F.lit("("), where, F.lit(")"))


def id_list(text: Column) -> Column:
    """array<long> of ``1:2:3``; null if one is no number."""
    ids = F.transform(F.split(text, ":", -1), lambda x: F.when(x.rlike("^[0-9]{1,18}$"), x.cast("long")))
    return F.when(~F.exists(ids, lambda x: x.isNull()), ids)


def is_archive(path: Column) -> Column:
    return path.rlike("\\.tar(\\.xz|\\.gz)?\\z")


def is_job_output(path: Column) -> Column:
    """Whether a source is the output of a job: by its name, inside some directory."""
    name = F.regexp_extract(path, "/([^/]*)\\z", 1)
    return path.contains("/") & (name.startswith("job-output") | name.contains("ansible"))


def older_than(is_local: Column, modified: Column, than: Column) -> Column:
    """Whether a source is older than a time; remote ones always count as older, unknown ages too."""
    return F.when(~is_local, True).otherwise(F.coalesce(modified.cast("long") < than.cast("long"), F.lit(True)))


def extended(index_name: Column, entry: Column) -> Column:
    """The index name of an archive's entry."""
    return F.concat(index_name, F.lit("__"), entry)
