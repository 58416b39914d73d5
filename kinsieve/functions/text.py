"""Scalar functions on paths, URLs, ids and replies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layouts of item folders, phrases of error pages, marks of page states.
CONTENT = r"(?i)/workshop/content/[0-9]+/([0-9]+)/"
LOCAL_NAME = r"(?i)/projects/myprojects/([^/]+)/"
LOCAL_ID = r"/projects/(?:myprojects|backup)/([0-9]+)/"
LOCAL_ROOT = r"(?i)^(.*?/myprojects/[^/]+)"
VIDEO = ("mp4", "mkv", "webm", "avi", "mov", "m4v", "mpg", "mpeg")
GONE = (
    "未找到", "不存在", "已被删除", "已被移除", "无法使用", "无效的物品", "您请求的项目", "处理您的请求时遇到错误", "查看物品时出现错误", "请稍后再试",
    "not found", "no longer available", "has been removed", "was removed", "invalid item",
    "an error occurred while processing your request", "there was an error viewing this item", "please try again later",
)
ERROR_BOX = r"""(?i)<[a-z][^>]*\s(?:class\s*=\s*["'](?:[^"'>]*\s)?(?:error_ctn|error)(?:\s[^"'>]*)?["']|id\s*=\s*["']error_box["'])"""
CAN_ADD = r"(?i)SubscribeItemOptionAdd"
CAN_REMOVE = r"(?i)SubscribeItemBtn[^>]*toggled|subscribeOption\s*\.?\s*remove|取消订阅|已订阅"


def slashed(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def path_key(path: Column) -> Column:
    return F.lower(slashed(path))


def _group(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def content_id(path: Column) -> Column:
    return _group(slashed(path), CONTENT)


def local_name(path: Column) -> Column:
    return _group(slashed(path), LOCAL_NAME)


def key_id(key: Column) -> Column:
    """An all-digit key is the id, else it stands in the path."""
    return F.when(key.rlike("^[0-9]+$"), key).otherwise(content_id(key))


def archive_id(local: Column, item_id: Column, project: Column, file: Column) -> Column:
    return F.when(local & F.coalesce(item_id, F.lit("")).isin(""), _group(path_key(F.coalesce(F.nullif(project, F.lit("")), file)), LOCAL_ID))


def item_url(item_id: Column, path: Column, prefix: str) -> Column:
    return F.when(item_id.startswith("mp:"), F.concat(F.lit("file://"), path)).otherwise(F.concat(F.lit(prefix), item_id))


def twin_paths(path: Column, content_root: str, local_root: str) -> Column:
    """Where the same file may lie under the other root."""
    if not content_root or not local_root:
        return F.expr("cast(array() as array<string>)")
    a, b = content_root.rstrip("/") + "/", local_root.rstrip("/") + "/"
    other = lambda x, y: F.when(path.startswith(x), F.concat(F.lit(y), F.substring(path, F.lit(len(x) + 1), F.length(path))))
    return F.array_compact(F.array(other(a, b), other(b, a)))


def joined_path(folder: Column, rel: Column) -> Column:
    return F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"), F.ltrim(rel, F.lit("/")))


def url_id(url: Column) -> Column:
    """The first id parameter, trimmed, or the empty text."""
    return F.trim(F.coalesce(F.regexp_extract(url, r"^[^?#]*\?(?:[^#]*?&)?id=([^&#]*)", 1), F.lit("")))


def _pairs(query: Column) -> Column:
    return F.filter(F.split(query, "&"), lambda p: p.contains("=") & ~p.endswith("="))


def _set(query: Column, key: str, value: Column) -> Column:
    """Parameters in order of first appearance, each with its last value; key set to value."""
    name = lambda p: F.substring_index(p, "=", 1)
    pairs = F.concat(_pairs(query), F.array(F.concat(F.lit(f"{key}="), value)))
    names = F.array_distinct(F.transform(pairs, name))
    return F.array_join(F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda p: name(p) == n), -1)), "&")


def set_query(url: Column, key: str, value: Column) -> Column:
    base, rest = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    return F.concat(base, F.lit("?"), _set(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), key, value), rest)


def set_fragment(url: Column, key: str, value: Column) -> Column:
    return F.concat(F.regexp_extract(url, r"^([^#]*)", 1), F.lit("#"), _set(F.regexp_extract(url, r"#(.*)$", 1), key, value))


def is_link(cell: Column) -> Column:
    t = F.trim(cell)
    return F.coalesce(t.startswith("http") | F.lower(t).startswith("file:"), F.lit(False))


def file_uri_path(uri: Column) -> Column:
    """The path of a file URI, decoded once; a host makes it a share path; anything else is null."""
    u = F.trim(uri)
    host, raw = F.regexp_extract(u, r"(?i)^file://([^/]*)", 1), F.regexp_extract(u, r"(?i)^file:(?://[^/]*)?([^?#]*)", 1)
    path = F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.when(u.rlike("(?i)^file:"), F.when(host != "", F.concat(F.lit("//"), host, F.lit("/"), F.ltrim(path, F.lit("/")))).otherwise(path))


def local_root(path: Column) -> Column:
    return _group(slashed(path), LOCAL_ROOT)


def ids_in_text(text: Column) -> Column:
    """Runs of digits, each once, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('(?i)href="([^"]+)"'), F.lit(1))


def pair_list(entries: Column) -> Column:
    """Pairs a|b or a,b in text order of their ends; self pairs and halves dropped, each once."""
    split = F.transform(entries, lambda e: F.filter(F.transform(F.split(F.replace(e, F.lit(","), F.lit("|")), r"\|"), lambda x: F.trim(x)), lambda x: x != ""))
    pairs = F.transform(F.filter(split, lambda p: F.size(p) >= 2), lambda p: F.array_sort(F.slice(p, 1, 2)))
    return F.array_distinct(F.filter(pairs, lambda p: F.get(p, F.lit(0)) != F.get(p, F.lit(1))))


def subscription_state(html: Column) -> Column:
    add, remove = html.rlike(CAN_ADD), html.rlike(CAN_REMOVE)
    return F.when(remove & ~add, "subscribed").when(add & ~remove, "not_subscribed").otherwise("unknown")


def has_error_box(html: Column) -> Column:
    """Whether some element is an error box, by a word of its class or by its id."""
    return F.coalesce(html.rlike(ERROR_BOX), F.lit(False))


def is_gone(title: Column, body: Column, has_button: Column, html: Column | None = None) -> Column:
    """Whether a page tells that its item is gone: by its title, a phrase of its text, an error box in its html, or as a short text about an error."""
    low = F.lower(body)
    hit = low.contains(GONE[0])
    for phrase in GONE[1:]:
        hit = hit | low.contains(phrase)
    short = ~has_button & F.length(body).between(1, 199) & body.rlike(r"(?i)error|错误|not\s*found|removed")
    return F.coalesce(F.lower(title).rlike("错误|error"), F.lit(False)) | hit | short | (has_error_box(html) if html is not None else F.lit(False))


def response_ok(text: Column) -> Column:
    """Whether a reply is JSON 1, true, or an object whose success is 1, true or "1"."""
    v = F.try_parse_json(F.trim(text))
    whole, own = F.trim(text), F.try_variant_get(v, "$.success", "string")
    return F.coalesce(whole.isin("1", "true") | own.isin("1", "true"), F.lit(False))


def status_ok(ok: Column, status: Column) -> Column:
    """An explicit flag wins; else fail or error in the status is false, other text true, none null."""
    low = F.lower(F.trim(status))
    return F.coalesce(ok, F.when(low.contains("fail") | low.contains("error"), F.lit(False)).when(low != "", F.lit(True)))


def digest(parts: Column) -> Column:
    return F.sha1(F.array_join(parts, "|").cast("binary"))


def job_id(ids: Column) -> Column:
    """Identity of a set of ids, whatever their order."""
    quoted = F.transform(F.array_sort(F.array_distinct(ids)), lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    return F.sha2(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")).cast("binary"), 256)


def lease_token(job: Column, item: Column, attempt: Column) -> Column:
    return F.sha1(F.concat_ws(":", job, item, attempt.cast("string")).cast("binary"))


def toml_scalar(x: Column, kind: str) -> Column:
    """A value of that kind (string, boolean, int, double) as TOML text; strings are quoted as in JSON."""
    if kind == "string":
        quoted = F.to_json(F.array(x))
        return F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    return x.cast("string")
