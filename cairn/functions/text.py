"""Names, paths and addresses as Column expressions (no user functions)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: the 32 letters of store hashes; no e, o, t, u
BASE32 = "0123456789abcdfghijklmnpqrsvwxyz"
#: fixed values: forges whose archive addresses can name a commit (pattern after the scheme, address with groups)
FORGES = {
    "github": (r"^github\.com/([^/]+)/([^/]+)/archive/(.+)\.(tar\.gz)$", "https://github.com/{1}/{2}/archive/{c}.{4}"),
    "gitlab": (r"^gitlab\.com/([^/]+)/([^/]+)/-/archive/([^/]+)/(.+)\.(tar\.gz)$", "https://gitlab.com/{1}/{2}/-/archive/{c}/{2}-{c}.{5}"),
    "bitbucket": (r"^bitbucket\.org/([^/]+)/([^/]+)/get/(.+)\.(tar\.gz)$", "https://bitbucket.org/{1}/{2}/get/{c}.{4}"),
    "codeberg": (r"^codeberg\.org/([^/]+)/([^/]+)/archive/(.+)\.(tar\.gz)$", "https://codeberg.org/{1}/{2}/archive/{c}.{4}"),
    "sourcehut": (r"^git\.sr\.ht/~([^/]+)/([^/]+)/archive/(.+)\.(tar\.gz)$", "https://git.sr.ht/~{1}/{2}/archive/{c}.{4}"),
}
RELEASE_ARCHIVE = r"^https://releases\.nixos\.org/.*/(nix(?:os|pkgs)-\d\d\.\d\d(?:\.|pre)\d+).[a-z0-9]+/nixexprs\.tar"
#: fixed values: package outputs that a version may be followed by
OUTPUTS = ("-man", "-bin", "-lib", "-libgcc", "-dev", "-doc", "-info", "-getent", "-xz", "-zstd", "-modules", "-modules-shrunk", "-drivers", "--p11kit", "-xxd")
VERSION = r"^(.+?)-([0-9].*?)(" + "|".join(OUTPUTS) + r")?$"

# fixed values: outputs and compressions that stand behind a version, and packages whose versions have letters
PATTERN_OUTPUTS = ("bin", "data", "doc", "info", "man", "dev", "lib")
FIRMWARE_FORMS = ("xz", "zstd")
ODD_VERSIONS = ("spotify", "webkitgtk")


def store_hash(path: Column) -> Column:
    """Hash part of a store path's last component: up to its first dash, if it is 32 letters of BASE32."""
    h = F.substring_index(F.substring_index(path, "/", -1), "-", 1)
    return F.when(h.rlike(f"^[{BASE32}]{{32}}$"), h)


def store_name(path: Column) -> Column:
    """Name part, behind the first dash; null without one."""
    base = F.substring_index(path, "/", -1)
    at = F.instr(base, "-")
    return F.when(at > 0, F.substr(base, at + 1))


def dash_count(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("-"), F.lit("")))


def head_token(name: Column) -> Column:
    """Through the first dash; the whole name without one."""
    return F.when(F.instr(name, "-") > 0, F.concat(F.substring_index(name, "-", 1), F.lit("-"))).otherwise(name)


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix: where the characters differ first."""
    both = F.least(F.length(a), F.length(b))
    differ = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(both == 0, 0).otherwise(F.when(differ > 0, F.least(both, differ.cast("int") - 1)).otherwise(both))


def without_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/$", "")


def with_slash(url: Column) -> Column:
    return F.when(F.endswith(url, F.lit("/")), url).otherwise(F.concat(url, F.lit("/")))


def archive_name(url: Column) -> Column:
    """Package name of an archive's address: releases by version, others by file name without .gz, .xz, .tar."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring_index(url, "/", -1), r"\.gz$", ""), r"\.xz$", ""), r"\.tar$", "")
    release = F.regexp_extract(url, RELEASE_ARCHIVE, 1)
    return F.when(release != "", F.concat(F.lit("nixexprs-"), release)).otherwise(name)


def commit_url(url: Column, commit: Column) -> Column:
    """The address of the same archive at a commit; null if no forge's pattern fits."""
    rest, out = F.regexp_replace(url, "^https?://", ""), F.lit(None).cast("string")
    for pattern, form in reversed(FORGES.values()):
        parts = [commit if p == "c" else F.regexp_extract(rest, pattern, int(p)) if p.isdigit() else F.lit(p) for p in _pieces(form)]
        out = F.when(rest.rlike(pattern), F.concat(*parts)).otherwise(out)
    return out


def _pieces(form: str) -> Iterable[str]:
    for i, p in enumerate(form.replace("{", "}").split("}")):
        if p:
            yield p if i % 2 else p


def forge_of(url: Column) -> Column:
    rest, out = F.regexp_replace(url, "^https?://", ""), F.lit(None).cast("string")
    for name, (pattern, _) in FORGES.items():
        out = F.when(rest.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def sanitized(name: Column) -> Column:
    return F.array_join(F.regexp_extract_all(name, F.lit(r"[a-zA-Z0-9+\-_?=.]+"), F.lit(0)), "_")


def is_commit(text: Column) -> Column:
    return text.rlike("^[0-9a-f]{40}([0-9a-f]{24})?$")


def release_number(release: Column) -> Column:
    parts = F.split(release, r"\.")
    return F.when(F.size(parts) > 2, F.coalesce(F.try_element_at(parts, F.lit(-2)).try_cast("long"), F.lit(0))).otherwise(0)


def release_url(channel: Column, release: Column) -> Column:
    return F.concat(F.lit("https://releases.nixos.org/"), F.replace(channel, F.lit("-"), F.lit("/")), F.lit("/"), release, F.lit("/nixexprs.tar.xz"))


def package_version(name: Column) -> tuple[Column, Column]:
    """(package, version) of name-version-output; both empty where there's no version."""
    return F.regexp_extract(name, VERSION, 1), F.regexp_extract(name, VERSION, 2)


def clean_path(path: Column) -> Column:
    """Absolute, with single slashes, without . parts and a last slash (.. is not expected in archives)."""
    p = F.regexp_replace(F.concat(F.lit("/"), path), r"/(\./)*(\.$)?", "/")
    p = F.regexp_replace(p, "/+", "/")
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/$", ""))


def dir_name(path: Column) -> Column:
    d = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(d == "", "/").otherwise(d)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def compression(path: Column) -> Column:
    return F.when(F.endswith(path, F.lit(".gz")), "gz").when(F.endswith(path, F.lit(".xz")), "xz").when(F.endswith(path, F.lit(".zst")), "zstd").otherwise("none")


def under(path: Column, directory: Column) -> Column:
    """A path is under a directory if it is it or starts with it at a component's end; all are under /."""
    return (path == directory) | (directory == "/") | F.startswith(path, F.concat(directory, F.lit("/")))


def recompress_class(path: Column) -> Column:
    """Files worth expanding before they are compared: compressed manual pages and kernel modules."""
    parts = F.split(path, "/")
    module = F.startswith(path, F.lit("/lib/modules/")) & F.endswith(path, F.lit(".ko.xz")) & (F.get(parts, F.lit(3)) != "") & (F.get(parts, F.lit(4)) == "kernel") & (F.size(parts) > 5)
    manual = F.startswith(path, F.lit("/share/man/")) & F.endswith(path, F.lit(".gz"))
    return F.when(manual, "gz").when(F.coalesce(module, F.lit(False)) & (base_name(path) != "kheaders.ko.xz"), "xz").otherwise("none")


def include_pattern(name: Column) -> Column:
    """A pattern for all versions of a package; null where none can be made. A name is words joined by dashes: the package,
    its version (the words of digits and dots at the end), and an output or, of firmware, a compression behind it."""
    words = F.split(name, "-")
    last = F.element_at(words, -1)
    compressed = last.isin(*FIRMWARE_FORMS)
    has_suffix = last.isin(*PATTERN_OUTPUTS) | compressed
    body = F.when(has_suffix, F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(1)))).otherwise(words)
    other = F.array_position(F.transform(F.reverse(body), lambda w: w.rlike("[^0-9.]")), True)
    version = F.least(F.when(other > 0, other.cast("int") - 1).otherwise(F.size(body)), F.size(body) - 1)
    package = F.array_join(F.slice(body, 1, F.greatest(F.size(body) - version, F.lit(1))), "-")
    suffix = F.when(has_suffix, F.concat(F.lit("-"), last)).otherwise("")
    firmware = F.lower(package).like("%-firmware") | F.lower(package).like("firmware")
    any_version = (version > 0) & (~compressed | firmware)
    unversioned = compressed & firmware & (version == 0)
    odd = words[0].isin(*ODD_VERSIONS) & (F.size(words) > 1)
    return F.when(any_version, F.concat(package, F.lit("-.*"), suffix)).when(unversioned, name).when(odd, F.concat(words[0], F.lit("-.*")))


def package_mode(store: Column, size: Column, name: Column, stores: list[str], local: str, least: int, exclude: list[str], on_demand: list[str], materialize: list[str]) -> Column:
    """How a package is fetched: off, on_demand or materialize. The local store passes always; others must be
    listed, and the package of a least size. Exclusions win over on-demand, these over materialized."""
    store_ = without_slash(store)
    allowed = (store_ == local.rstrip("/")) | (store_.isin([s.rstrip("/") for s in stores]) & (size >= least))
    fits = lambda patterns: F.coalesce(F.greatest(*[name.rlike(f"^(?:{p})$") for p in patterns], F.lit(False)), F.lit(False))
    return F.when(~allowed | fits(exclude), "off").when(fits(on_demand), "on_demand").when(fits(materialize), "materialize").otherwise("off")


def is_public(signatures: Column, trusted: str, known: Column) -> Column:
    """Any trusted signature: public. Only others: not. None at all: as known elsewhere."""
    return F.when(F.exists(signatures, lambda s: F.startswith(s, F.lit(trusted))), True).when(F.size(signatures) > 0, False).otherwise(F.coalesce(known, F.lit(False)))
