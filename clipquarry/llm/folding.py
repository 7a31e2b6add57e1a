"""Character folding shared by the text detectors: look-alike letters of other scripts to ASCII, one character to one."""

from __future__ import annotations

import re

from .common import by_value

_PAIRS = (
    "аaвbсcеeнhіiјjкkмmоoрpѕsтtхxуyԁdԛqԝwӏlһh"  # Cyrillic
    "АaВbСcЕeНhІiЈjКkМmОoРpЅsТtХxУyӀl"
    "αaβbεeηnιiκkνvοoρpτtυuχxγyωwΑaΒbΕeΖzΗhΙiΚkΜmΝnΟoΡpΤtΥyΧxϲc"  # Greek
    "ıiİiɑaɡgɩiʟlɴnʀrꜱsᴀaᴄcᴅdᴇeᴊjᴋkᴍmᴏoᴘpᴛtᴜuᴠvᴡwᴢz"
)
LOOKALIKES: dict[int, str] = {ord(a): b for a, b in zip(_PAIRS[::2], _PAIRS[1::2], strict=True)}
LOOKALIKES |= {0xFF01 + k: chr(0x21 + k).lower() for k in range(94)}  # full width
LOOKALIKES |= {base + k: str(k) for base in (0x0660, 0x06F0, 0x0966) for k in range(10)}  # Arabic and Indic digits
LOOKALIKES |= {0x1D7CE + k: str(k % 10) for k in range(50)}
LOOKALIKES |= {0x1D400 + k: chr(97 + k % 26) for k in range(13 * 52)}  # mathematical alphabets
LOOKALIKES |= {0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2014: "-", 0x2212: "-", 0x2024: ".", 0x3002: ".", 0xFE52: ".", 0xFE6B: "@", 0x00A0: " ", 0x202F: " ", 0x2009: " ", 0x3000: " "}
#: Characters without width, which disguises put between others.
INVISIBLE = "​‌‍⁠﻿­"

#: Any character that folding changes or drops.
ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in LOOKALIKES if c < 0x10000) + INVISIBLE + "\U0001d400-\U0001d7ff]")


def lower_folded(text: str) -> str:
    """Lower case and look-alikes folded, of the same length as text."""
    if text.isascii():
        return text.lower()
    out = (text.translate(LOOKALIKES) if ODD.search(text) else text).lower()
    return out if len(out) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text.translate(LOOKALIKES))


by_value(__name__)
