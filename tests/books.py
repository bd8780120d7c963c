"""Small archives for tests."""

import io
import zipfile


def epub(files: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def opf(items: list[str], meta: str = "<dc:title>T</dc:title>", extra: str = "") -> str:
    rows = "".join(f'<item id="i{k}" href="{x}"/>' for k, x in enumerate(items))
    return f'<?xml version="1.0"?><package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>{meta}</metadata><manifest>{rows}{extra}</manifest></package>'


def point(title: str, src: str | None, *children: str) -> str:
    content = f'<content src="{src}"/>' if src else ""
    return f"<navPoint><navLabel><text>{title}</text></navLabel>{content}{''.join(children)}</navPoint>"


def ncx(*points: str) -> str:
    return f"<ncx><navMap>{''.join(points)}</navMap></ncx>"


def page(body: str, title: str = "T") -> str:
    return f"<html><head><title>{title}</title></head><body>{body}</body></html>"


def archives(spark, books: dict[str, bytes]):
    return spark.createDataFrame([(f"/lib/{n}.epub", bytearray(b)) for n, b in books.items()], "path string, content binary")
