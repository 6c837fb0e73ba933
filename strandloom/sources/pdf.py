"""A4 sheets as one-bit PDF pages, written without any PDF library."""

from __future__ import annotations

import zlib

import numpy as np

WIDTH, HEIGHT, MARGIN, HEADER, THRESHOLD = 2480, 3508, 120, 110, 195


def sheet(bands: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """A white sheet with bands at their y below margin and header; a band that is too tall raises."""
    page = np.full((HEIGHT, WIDTH), 255, np.uint8)
    for y, band in bands:
        top = MARGIN + HEADER + y
        if top + band.shape[0] > HEIGHT:
            raise ValueError("a band does not fit on the sheet")
        page[top : top + band.shape[0], MARGIN : MARGIN + band.shape[1]] = band[:, : WIDTH - MARGIN]
    return page


def packed(image: np.ndarray) -> tuple[int, int, bytes]:
    """Height, width and compressed one-bit rows of a grey page."""
    return *image.shape, zlib.compress(np.packbits(image > THRESHOLD, axis=1).tobytes())


def _said(title: str) -> bytes:
    """A line of text as the body of a string in Latin-1; other characters become question marks."""
    raw = title.encode("latin-1", "replace")
    return b"".join(bytes([c]) if 31 < c < 127 and c not in b"()\\" else b"\\%03o" % c for c in raw)


def document(pages: list[tuple[int, int, bytes, str]]) -> bytes:
    """A PDF of packed pages with a line of text each."""
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for h, w, bits, title in pages:
        objects.append(b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /BitsPerComponent 1 /ColorSpace /DeviceGray /Filter /FlateDecode /Length %d >>\nstream\n" % (w, h, len(bits)) + bits + b"\nendstream")
        picture = len(objects)
        body = b"q 595 0 0 842 0 0 cm /I Do Q BT /F 14 Tf 29 790 Td (" + _said(title) + b") Tj ET"
        objects.append(b"<< /Length %d >>\nstream\n" % len(body) + body + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents %d 0 R /Resources << /XObject << /I %d 0 R >> /Font << /F 3 0 R >> >> >>" % (picture + 1, picture))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(kids))
    out, places = [b"%PDF-1.4\n"], []
    size = len(out[0])
    for i, body in enumerate(objects, 1):
        places.append(size)
        out.append(b"%d 0 obj\n" % i + body + b"\nendobj\n")
        size += len(out[-1])
    out.append(b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places))
    out.append(b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, size))
    return b"".join(out)
