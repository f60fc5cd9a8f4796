"""Where text comes from: strings, paths, archives, URLs, iterables; and which kind a source is."""

from __future__ import annotations

import base64
import gzip
import io
import lzma
import tarfile
import urllib.request
import warnings
import zipfile
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from ..errors import AuthenticationWarning

TIMEOUT = 60


def kind_of(source: Any) -> str:
    if isinstance(source, Path):
        return "path"
    if not isinstance(source, str):
        return "iterable"
    if "\n" in source:
        return "string"
    name = source.lower()
    if name.startswith(("http://", "https://")):
        return "url"
    for ends, kind in (((".tar.gz", ".tgz"), "tar_gzip"), ((".gz",), "gzip"), ((".xz", ".lzma"), "lzma"), ((".zip",), "zip")):
        if name.endswith(ends):
            return kind
    return "file"


def _member(names: list[str], wanted: str | None, stem: str) -> str:
    if wanted is not None:
        return wanted
    if stem in names:
        return stem
    if len(names) == 1:
        return names[0]
    raise ValueError(f"the archive has {len(names)} members and none is named {stem}")


def fetch_url(url: str, encoding: str, **kw: Any) -> str:
    headers = dict(kw.get("headers") or {})
    if kw.get("username") is not None:
        if url.lower().startswith("http://"):
            warnings.warn("credentials travel unencrypted", AuthenticationWarning, stacklevel=3)
        headers["Authorization"] = "Basic " + base64.b64encode(f"{kw['username']}:{kw.get('password') or ''}".encode()).decode()
    context = kw.get("context")
    if context is None and any(kw.get(k) for k in ("cafile", "capath", "cadata")):
        import ssl

        context = ssl.create_default_context(cafile=kw.get("cafile"), capath=kw.get("capath"), cadata=kw.get("cadata"))
    request = urllib.request.Request(url, data=kw.get("data"), headers=headers)  # noqa: S310
    with urllib.request.urlopen(request, timeout=kw.get("timeout", TIMEOUT), context=context) as answer:  # noqa: S310
        return answer.read().decode(encoding)


URL_OPTIONS = ("headers", "data", "username", "password", "cafile", "capath", "cadata", "context", "timeout")


def read_text(source: Any, encoding: str = "utf-8", zippath: str | None = None, **url: Any) -> str:
    """The whole text of a source that Spark can't split."""
    kind = kind_of(source)
    if kind == "string":
        return source
    if kind == "iterable":
        if hasattr(source, "read"):
            text = source.read()
            return text.decode(encoding) if isinstance(text, bytes) else text
        return "\n".join(str(line).rstrip("\n") for line in source) + "\n"
    if kind == "url":
        return fetch_url(source, encoding, **url)
    path = Path(source)
    if kind == "path":
        kind = kind_of(str(source))
    if kind == "gzip":
        return gzip.decompress(path.read_bytes()).decode(encoding)
    if kind == "lzma":
        return lzma.decompress(path.read_bytes()).decode(encoding)
    if kind == "zip":
        with zipfile.ZipFile(path) as z:
            names = [n for n in z.namelist() if not n.endswith("/")]
            return z.read(_member(names, zippath, path.stem)).decode(encoding)
    if kind == "tar_gzip":
        with tarfile.open(fileobj=io.BytesIO(path.read_bytes()), mode="r:gz") as t:
            names = [m.name for m in t.getmembers() if m.isfile()]
            stem = path.name.removesuffix(".gz").removesuffix(".tar").removesuffix(".tgz")
            return t.extractfile(_member(names, None, stem)).read().decode(encoding)
    return path.read_text(encoding)


def splittable(source: Any) -> bool:
    """Whether Spark reads it: plain files, folders, gzip, and other file systems."""
    kind = kind_of(source)
    return kind in ("file", "gzip") or (kind == "path" and kind_of(str(source)) in ("file", "gzip"))


def lines_of(source: Any) -> Iterable[str]:
    return source if not isinstance(source, (str, Path)) else read_text(source).splitlines()
