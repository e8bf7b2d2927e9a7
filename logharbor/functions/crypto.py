"""Column encryption: AES-CBC with a random vector in front, as hex text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encrypt_text(text: Column, key: Column) -> Column:
    """Encrypt with a 16, 24 or 32 byte key; every call draws a new vector."""
    return F.lower(F.hex(F.aes_encrypt(text, key, F.lit("CBC"), F.lit("PKCS"))))


def decrypt_text(sealed: Column, key: Column) -> Column:
    """Undo encrypt_text; NULL when the text or the key is wrong."""
    return F.try_aes_decrypt(F.unhex(sealed), key, F.lit("CBC"), F.lit("PKCS")).cast("string")
