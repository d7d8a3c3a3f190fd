"""Private keys go with all their material."""

import pytest
from sievelake.functions import redact as RD

KIND = "PRIVATE" + " KEY"
OPEN, CLOSE = (f"-----{w} RSA {KIND}-----" for w in ("BEGIN", "END"))
LINES = ["MIIEowIBAAKCAQEA" + c * 48 for c in "abcdef"]
TEXTS = {
    "a block": ("x\n" + "\n".join([OPEN, *LINES, CLOSE]) + "\ny", "x\n[REDACTED:private-key]\ny"),
    "escaped": ("x\\n" + "\\n".join([OPEN, *LINES, CLOSE]) + "\\ny", "x\\n[REDACTED:private-key]\\ny"),
    "headers": ("\n".join([OPEN, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,00FF", "", *LINES, CLOSE]) + " y", "[REDACTED:private-key] y"),
    "cut short": ("\n".join([OPEN, *LINES]) + "\nThe prose behind it stays, all of it.\n-----\n", "[REDACTED:private-key]\nThe prose behind it stays, all of it.\n-----\n"),
    "cut and escaped": ("\\n".join([OPEN, *LINES]) + "\\nand prose", "[REDACTED:private-key]\\nand prose"),
    "pgp": (f"-----BEGIN PGP {KIND} BLOCK-----\nVersion: a-b\n\n{LINES[0]}\n-----END PGP {KIND} BLOCK-----", "[REDACTED:private-key]"),
    "long": ("\n".join([OPEN, *LINES * 2000, CLOSE]), "[REDACTED:private-key]"),
    "long and cut": ("\n".join([OPEN, *LINES * 2000]) + "\nend", "[REDACTED:private-key]\nend"),
    "public": ("-----BEGIN PUBLIC KEY-----\n" + LINES[0], "-----BEGIN PUBLIC KEY-----\n" + LINES[0]),
}


@pytest.mark.parametrize("name", TEXTS)
def test_private_keys(spark, name):
    text, want = TEXTS[name]
    df = spark.createDataFrame([(text,)], "t string")
    once = df.select(RD.redact(df.t).alias("t"))
    assert once.first().t == want
    assert once.select(RD.redact(once.t).alias("t")).first().t == want
