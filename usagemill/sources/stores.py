"""Files of the shared store as tasks see them: through Arrow's file systems, which need access to the same store."""

from __future__ import annotations

from urllib.parse import quote, unquote


def store_of(path: str, named_by_spark: bool = True):
    """The file system of a path and its name there; names by Spark are percent-encoded, plain ones are not."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    plain = unquote if named_by_spark else str
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + plain(rest if colon else path).lstrip("/")
    return fs.FileSystem.from_uri(quote(plain(path.replace("s3a://", "s3://", 1)), safe=":/@=+,"))
