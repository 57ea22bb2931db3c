import datetime as dt
import ipaddress

import pytest

from tessera.llm import pii

NET = pii.Feistel(b"key")


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000])
def test_permutation_and_inverse(size):
    image = [NET.permute("t", x, size) for x in range(size)]
    assert sorted(image) == list(range(size))
    assert [NET.undo("t", y, size) for y in image] == list(range(size))


def test_formats_stay_valid_and_values_stay_linked():
    text = ("(543) 555-9258 +1 543-555-9258 4349000490986231 4349-0004-9098-6231 67.190.110.215 jo.d46@mail.example.com "
            "1980-02-28 28.2.1980 123-45-6789 DE89 3704 0044 0532 0130 00 +49 30 1234567")
    out, found = pii.pseudonymise(text, NET.permute)
    kinds = [f[0] for f in found]
    assert kinds == ["phone", "phone", "card", "card", "ip", "email", "ymd", "dmy", "ssn", "iban", "intl"]
    new = [f[3] for f in found]
    digits = ["".join(c for c in v if c.isdigit()) for v in new]
    assert digits[0] == digits[1][1:] and digits[2] == digits[3]
    assert int(digits[2][-1]) == pii.luhn_digit(digits[2][:-1])
    assert all(0 <= int(o) <= 255 for o in new[4].split("."))
    d, m, y = map(int, new[7].split("."))
    assert dt.date.fromisoformat(new[6]) == dt.date(y, m, d)
    iban = new[9].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert new[5].endswith("@mail.example.com") and len(new[5]) == len("jo.d46@mail.example.com")
    for kind, s, e, _ in found:
        assert text[s:e] not in out
    back, _ = pii.pseudonymise(out, NET.undo)
    assert back == text


def test_dates_in_all_shapes_share_a_pseudonym():
    shapes = ["1980-02-28", "1980-02-28T10:00:00Z", "1980/02/28", "28-02-1980", "28.02.1980", "28/02/1980", "28 February 1980",
              "28th FEB 1980", "February 28, 1980", "feb. 28 1980", "28 Feb, 1980"]
    days = set()
    for v in shapes:
        out, found = pii.pseudonymise(f"on {v}, they said", NET.permute)
        assert len(found) == 1 and "1980" not in out and out.startswith("on ") and out.endswith(", they said")
        kind, _, _, new = found[0]
        if kind in ("dayname", "nameday"):
            name = next(w for w in new.replace(".", " ").replace(",", " ").split() if w.isalpha())
            m = [x[:3].lower() for x in pii.MONTHS].index(name[:3].lower()) + 1
            d, y = (int("".join(c for c in w if c.isdigit())) for w in new.replace(",", "").split() if any(c.isdigit() for c in w))
        else:
            p = [int(x) for x in new.replace("/", "-").replace(".", "-").split("-")]
            y, m, d = p if p[0] > 31 else p[::-1]
        days.add(dt.date(y, m, d))
    assert len(days) == 1
    plain = " | ".join(s for s in shapes if "th" not in s)
    back, n = pii.pseudonymise(pii.pseudonymise(plain, NET.permute)[0], NET.undo)
    assert back == plain and len(n) == len(shapes) - 1
    ends = [pii.pseudonymise(f"{d}th March 2001", NET.permute)[0].split()[0] for d in range(4, 21)]
    assert all(e.endswith("th") if int(e[:-2]) in (*range(4, 21), *range(24, 31)) else e[-2:] in ("st", "nd", "rd") for e in ends)


def test_addresses_and_numbers_with_00():
    text = "from 2001:db8::8a2e:370:7334, fe80::1ff:fe23:4567:890a and fd12:3456:789a:1::1: call 0049 30 1234567 or +49 30 1234567"
    out, found = pii.pseudonymise(text, NET.permute)
    assert [f[0] for f in found] == ["ip6", "ip6", "ip6", "out", "intl"]
    new = [f[3] for f in found]
    assert all(ipaddress.IPv6Address(v) for v in new[:3]) and new[0][0] in "23" and new[1][:4] == "fe80" and new[2][:4] == "fd12"
    assert new[3][2:] == new[4][1:] and new[3] != "0049 30 1234567"
    assert pii.pseudonymise(out, NET.undo)[0] == text
    other = "2001:0DB8:0:0:0:8A2E:0370:7334"
    assert pii.pseudonymise(other, NET.permute)[0] == new[0].upper()


def test_shapes_that_are_none_stay():
    text = ("10:00:00 aa:bb:cc:dd:ee:ff std::vector fade::face ::1 2021/13/04 /2021/03/04/ 30-02-1980 31 June 1980 "
            "May 1980 In March 12 people 0049301234567 1980.02.28 12-34-5678-9012 3-2-1 2001:db8:::1")
    assert pii.pseudonymise(text, NET.permute) == (text, [])


def test_invalid_values_stay():
    text = "4111111111111112 1980-02-30 999.1.1.1 000-12-3456 (123) 555-0000 v4.0. 12345 a@b DE00 3704 0044 0532 0130 00"
    assert pii.pseudonymise(text, NET.permute) == (text, [])


def test_key_matters():
    a, b = (pii.pseudonymise("4349000490986231", pii.Feistel(k).permute)[0] for k in (b"a", b"b"))
    assert a != b


def test_table(odd, nothing):
    got = pii.pseudonymise_table(odd)
    assert got.columns == [*odd.columns, "pii"] and got.count() == odd.count()
    assert sorted(str(r.text) for r in got.collect()) == sorted(str(r.text) for r in odd.collect())
    assert pii.pseudonymise_table(nothing).count() == 0


def test_texts_are_taken_in_small_pieces(spark, monkeypatch):
    """A batch of any size is worked on piece by piece, with the same rows."""
    rows = [(i, None if i % 7 == 0 else f"é{i} mail a{i}@example.org on 1980-02-28 " * (i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    whole = pii.pseudonymise_table(df).collect()
    monkeypatch.setattr(pii, "PIECE", 50)
    assert pii.pseudonymise_table(df).collect() == whole and len(whole) == 60
