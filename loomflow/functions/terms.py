"""Names of graph terms: namespaces, local names and minted URIs, as Python strings and as columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prefixes of the vocabularies.
NAMESPACES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "ex": "http://www.example.com#",
    "cf": "http://www.example.com/controlflow#",
    "docker": "http://www.example.com/docker#",
    "python": "http://www.example.com/python#",
    "dcterms": "http://purl.org/dc/terms/",
    "doap": "http://usefulinc.com/ns/doap#",
    "fno": "https://w3id.org/function/ontology#",
    "fnoi": "https://w3id.org/function/vocabulary/implementation#",
    "fnom": "https://w3id.org/function/vocabulary/mapping#",
    "fnoc": "https://w3id.org/function/vocabulary/composition#",
    "fnof": "http://example.com/vocabulary/flow#",
    "ptype": "http://example.com/ptype#",
    "prov": "http://www.w3.org/ns/prov#",
    "cc": "http://creativecommons.org/ns#",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "void": "http://rdfs.org/ns/void#",
    "mls": "http://www.w3.org/ns/mls#",
    "mlflow": "http://www.example.com/mlflow#",
    "do": "http://linkedcontainers.org/vocab#",
}


def bind(prefix: str, uri: str) -> None:
    """Set or replace a prefix for this process."""
    NAMESPACES[prefix] = uri


def expand(curie: str) -> str:
    """The URI of a prefixed name; anything without a known prefix stays as it is."""
    if curie == "a":
        return NAMESPACES["rdf"] + "type"
    prefix, sep, rest = curie.partition(":")
    return NAMESPACES[prefix] + rest if sep and prefix in NAMESPACES and not rest.startswith("//") else curie


def shorten(uri: str) -> str:
    """The prefixed name of a URI, by its longest namespace; a URI outside all of them stays as it is."""
    best = max((p for p, u in NAMESPACES.items() if uri.startswith(u)), key=lambda p: len(NAMESPACES[p]), default=None)
    return uri if best is None else f"{best}:{uri[len(NAMESPACES[best]):]}"


def expanded(curie: Column) -> Column:
    """expand() for a column."""
    table = F.create_map(*[F.lit(x) for pair in NAMESPACES.items() for x in pair])
    prefix = F.substring_index(curie, ":", 1)
    known = F.element_at(table, prefix)
    rest = F.substring(curie, F.length(prefix) + 2, F.length(curie))
    return F.when(curie == "a", NAMESPACES["rdf"] + "type").when(curie.contains(":") & known.isNotNull() & ~F.startswith(rest, F.lit("//")), F.concat(known, rest)).otherwise(curie)


def local_name(uri: Column) -> Column:
    """What follows the last number sign."""
    return F.substring_index(uri, "#", -1)


def prefix_of(uri: Column) -> Column:
    """The namespace with its number sign; empty without one."""
    return F.when(uri.contains("#"), F.substring(uri, F.lit(1), F.length(uri) - F.length(local_name(uri)))).otherwise("")


def to_uri(prefix: Column, name: Column) -> Column:
    """A name in a namespace, which may end with its number sign or not."""
    return F.concat_ws("#", F.rtrim(prefix, F.lit("#")), name)


def digest(*parts: Column) -> Column:
    """First 8 hex digits of the SHA-256 of the parts that are not null."""
    return F.substring(F.sha2(F.concat_ws("", *parts), 256), 1, 8)


def mint(name: str, *parts: str | None, prefix: str = "python") -> str:
    """URI of an implementation: its name and a digest of module, package and file."""
    return f"{NAMESPACES[prefix]}{name}{hashlib.sha256(''.join(p for p in parts if p).encode()).hexdigest()[:8]}"


def minted(name: Column, *parts: Column, prefix: str = "python") -> Column:
    """mint() for columns."""
    return F.concat(F.lit(NAMESPACES[prefix]), name, digest(*parts))


def strip_underscores(x: Column) -> Column:
    return F.btrim(x, F.lit("_"))


def strip_dashes(x: Column) -> Column:
    return F.ltrim(x, F.lit("-"))


def module_name(path: Column) -> Column:
    """A path's last part without the suffix .py."""
    return F.regexp_replace(base_name(path), r"\.py$", "")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Everything before the last slash; empty without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    """The suffix from the last dot of the last part on; a leading dot is no suffix."""
    return F.regexp_extract(base_name(path), r"(?<=[^.])(\.[^.]*)$", 1)


def file_path(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file://", "")


def moved(path: Column, source: Column, target: Column) -> Column:
    """The path with the leading folder source replaced by target."""
    return F.when(F.startswith(path, source), F.concat(target, F.substring(path, F.length(source) + 1, F.length(path)))).otherwise(path)
