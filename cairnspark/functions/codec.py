"""Text codecs as column expressions: signatures, commits, tags, pointers, headers, URLs."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnspark.model import BACKOFF_BASE_MS, BACKOFF_CAP_MS, BACKOFF_DOUBLINGS, BACKOFF_JITTER, RETRYABLE

# Formats.
SIGNATURE_PATTERN = r"^(.*) <(.*)> (-?\d+) ([+-])(\d{2})(\d{2})$"
LFS_VERSION = "version https://git-lfs.github.com/spec/v1"
BUNDLE_TITLE = "# v2 git bundle"
POSIX_CLASSES = {"alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\s", "punct": r"\p{Punct}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "xdigit": r"\p{XDigit}", "print": r"\p{Print}", "graph": r"\p{Graph}"}


def signature_text(name: Column, email: Column, when: Column, offset: Column) -> Column:
    """`name <email> seconds offset`, the offset in minutes with sign and four digits, as ids need it."""
    return F.format_string("%s <%s> %d %+05d", name, email, when, offset)


def signature_display(name: Column, email: Column, when: Column, offset: Column) -> Column:
    """The same with the offset as hours and minutes."""
    size = F.abs(offset)
    return F.format_string("%s <%s> %d %s%02d%02d", name, email, when, F.when(offset < 0, "-").otherwise("+"), F.floor(size / 60).cast("int"), size % 60)


def parse_signature(text: Column) -> Column:
    """struct<name,email,when,offset in minutes> of a signature with hours and minutes; null if it is none."""
    part = lambda i: F.regexp_extract(text, SIGNATURE_PATTERN, i)
    minutes = part(5).cast("int") * 60 + part(6).cast("int")
    found = F.struct(part(1).alias("name"), part(2).alias("email"), part(3).cast("bigint").alias("when"), F.when(part(4) == "-", -minutes).otherwise(minutes).alias("offset"))
    return F.when(text.rlike(SIGNATURE_PATTERN), found)


def commit_text(tree: Column, parents: Column, author: Column, committer: Column, message: Column, encoding: Column | None = None, gpg_signature: Column | None = None) -> Column:
    """A commit's payload: tree, parents, author and committer lines, encoding and signature if there are any, an empty line, the
    message. Further lines of a signature begin with a blank."""
    lines = F.concat(F.array(F.concat(F.lit("tree "), tree)), F.transform(parents, lambda p: F.concat(F.lit("parent "), p)), F.array(F.concat(F.lit("author "), author), F.concat(F.lit("committer "), committer)))
    for key, value in (("encoding ", encoding), ("gpgsig ", gpg_signature)):
        if value is not None:
            lines = F.concat(lines, F.array_compact(F.array(F.concat(F.lit(key), F.replace(value, F.lit("\n"), F.lit("\n "))))))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n\n"), message)


def parse_commit(text: Column) -> Column:
    """struct<tree,parents,author,committer,message,encoding,gpg_signature> of a commit's payload.

    A line that begins with a blank goes on with the one before it. What is missing is null.
    """
    head = F.substring_index(text, "\n\n", 1)
    lines = F.split(F.replace(head, F.lit("\n "), F.lit("\0")), "\n")
    after = lambda key: F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(key))), lambda x: F.replace(F.substr(x, F.lit(len(key) + 1)), F.lit("\0"), F.lit("\n")))
    first = lambda key: F.get(after(key), 0)
    return F.struct(
        first("tree ").alias("tree"), after("parent ").alias("parents"), first("author ").alias("author"), first("committer ").alias("committer"),
        F.substr(text, F.length(head) + 3).alias("message"), first("encoding ").alias("encoding"), first("gpgsig ").alias("gpg_signature"),
    )


def tag_text(target: Column, type_: Column, name: Column, tagger: Column, message: Column) -> Column:
    """A tag's payload; a null tagger leaves the line out."""
    return F.concat(F.concat_ws("\n", F.concat(F.lit("object "), target), F.concat(F.lit("type "), type_), F.concat(F.lit("tag "), name), F.concat(F.lit("tagger "), tagger)), F.lit("\n"), message)


def parse_tag(text: Column) -> Column:
    """struct<object,type,name,tagger,message> of a tag's payload; null if it does not begin as one. A missing tagger is null."""
    pattern = r"(?s)^object ([0-9a-f]+)\ntype (\w+)\ntag ([^\n]*)\n(?:tagger ([^\n]*)\n)?(.*)$"
    part = lambda i: F.regexp_extract(text, pattern, i)
    tagger = F.when(text.rlike(r"^[^\n]*\n[^\n]*\n[^\n]*\ntagger "), part(4))
    return F.when(text.rlike(pattern), F.struct(part(1).alias("object"), part(2).alias("type"), part(3).alias("name"), tagger.alias("tagger"), part(5).alias("message")))


def lfs_pointer(oid: Column, size: Column) -> Column:
    return F.concat(F.lit(f"{LFS_VERSION}\noid "), oid, F.lit("\nsize "), size.cast("string"), F.lit("\n"))


def parse_lfs(text: Column, standard: bool = True) -> Column:
    """struct<is_lfs,oid,size>. standard takes `oid sha256:` with 64 hex digits; otherwise a bare id of 1 to 64 characters."""
    oid = r"sha256:([0-9a-f]{64})" if standard else r"([^\n]{1,64})"
    pattern = rf"^version [^\r\n]*\noid {oid}\nsize ([1-9][0-9]{{0,17}})\n"
    hit = text.rlike(pattern)
    return F.struct(F.coalesce(hit, F.lit(False)).alias("is_lfs"), F.when(hit, F.regexp_extract(text, pattern, 1)).alias("oid"), F.when(hit, F.regexp_extract(text, pattern, 2).cast("bigint")).alias("size"))


def pkt_line(payload: Column) -> Column:
    """Four hex digits of the length, themselves included, before the payload; null is a flush."""
    return F.when(payload.isNull(), "0000").otherwise(F.concat(F.lpad(F.lower(F.hex(F.octet_length(payload) + 4)), 4, "0"), payload))


def bundle_header(refs: Column) -> Column:
    """Header of a bundle from an array of `id name` strings."""
    return F.concat(F.lit(f"{BUNDLE_TITLE}\n"), F.array_join(refs, "\n"), F.when(F.size(refs) > 0, "\n").otherwise(""), F.lit("\n"))


def parse_bundle_header(text: Column) -> Column:
    """array<struct<oid,name>> of the lines up to the empty one; null if the title is missing."""
    refs = F.filter(F.transform(F.split(F.substring_index(text, "\n\n", 1), "\n"), bundle_ref), lambda x: x.isNotNull())
    return F.when(F.startswith(text, F.lit(BUNDLE_TITLE)), refs)


def bundle_ref(line: Column) -> Column:
    """struct<oid,name> of a line of a bundle's header; null if it is no ref."""
    ref = F.struct(F.substring_index(line, " ", 1).alias("oid"), F.regexp_extract(line, r"^\S+ (.*)$", 1).alias("name"))
    return F.when(line.rlike(r"^[0-9a-f]{40,128} \S"), ref)


def posix_to_java(pattern: str) -> str:
    """An extended POSIX pattern for rlike: classes such as [:digit:] are the only difference that matters here."""
    return re.sub(r"\[:(\w+):\]", lambda m: POSIX_CLASSES[m[1]], pattern)


def url_class(url: Column) -> Column:
    """http, ssh or file."""
    return F.when(url.rlike("^https?://"), "http").when(url.rlike(r"^ssh://|^[^/:@]+@[^/:]+:"), "ssh").when(url.rlike("^file://|^/|^[.]"), "file")


def parse_ssh(url: Column) -> Column:
    """struct<user,host,port,path> of ssh://user@host:port/path or user@host:path."""
    full, short = r"^ssh://(?:([^@/]+)@)?([^:/]+)(?::(\d+))?(/.*)$", r"^(?:([^@/:]+)@)([^:/]+):(.*)$"
    is_full = url.rlike(full)
    part = lambda i, j: F.when(is_full, F.regexp_extract(url, full, i)).otherwise(F.regexp_extract(url, short, j))
    port = F.when(is_full & (F.regexp_extract(url, full, 3) != ""), F.regexp_extract(url, full, 3).cast("int")).otherwise(22)
    return F.struct(part(1, 1).alias("user"), part(2, 2).alias("host"), port.alias("port"), part(4, 3).alias("path"))


def retry_after_ms(value: Column) -> Column:
    """Milliseconds of a Retry-After header in seconds; anything else is 0."""
    return F.when(value.rlike(r"^\s*\d{1,9}\s*$"), F.trim(value).try_cast("bigint") * 1000).otherwise(F.lit(0).cast("bigint"))


def backoff_ms(attempt: Column, base: int = BACKOFF_BASE_MS, cap: int = BACKOFF_CAP_MS, key: Column | None = None, jitter: float = BACKOFF_JITTER) -> Column:
    """Delay before an attempt: doubled each time, up to a cap. With a key, a hash of it and of the attempt moves the delay up or
    down by at most the jitter, so that callers do not come back together and a repeated run gives the same."""
    delay = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2), F.least(attempt, F.lit(BACKOFF_DOUBLINGS))))
    if key is not None:
        delay = delay * (1 + jitter * (F.pmod(F.xxhash64(key, attempt), F.lit(2001)) - 1000) / 1000)
    return delay.cast("bigint")


def is_retryable(code: Column) -> Column:
    """Errors that may pass by themselves: I/O error, busy, try again."""
    return code.isin(*RETRYABLE)


def crc32_raw(data: Column) -> Column:
    """CRC-32 with its register at 0 at first and not inverted at the end, as a loop over bits gives it; F.crc32 is the usual one."""

    @F.pandas_udf("bigint")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else zlib.crc32(bytes(b), 0xFFFFFFFF) ^ 0xFFFFFFFF).astype("Int64")

    return run(data)


def submodule_section(name: Column, path: Column, url: Column, branch: Column) -> Column:
    """The section that adding a submodule appends to the list of submodules; a null branch leaves its line out."""
    line = lambda key, value: F.concat(F.lit(f"\t{key} = "), value)
    return F.concat(F.concat_ws("\n", F.concat(F.lit('[submodule "'), name, F.lit('"]')), line("path", path), line("url", url), line("branch", branch)), F.lit("\n"))


def filter_spec(spec: str) -> Column:
    """Predicate over (type, size, depth) of a partial-clone filter: blob:none, blob:limit=N with k, m or g, tree:N; + combines."""
    keep = F.lit(True)
    for one in spec.split("+"):
        if one == "blob:none":
            keep &= F.col("type") != "blob"
        elif m := re.fullmatch(r"blob:limit=(\d+)([kmg]?)", one):
            limit = int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2]]
            keep &= (F.col("type") != "blob") | (F.col("size") < limit)
        elif m := re.fullmatch(r"tree:(\d+)", one):
            keep &= F.col("depth") < int(m[1])
        else:
            raise ValueError(f"no filter {one}")
    return keep
