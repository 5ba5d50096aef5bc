"""Word patterns that several operators share (fixed values)."""

#: A run of characters other than ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: One ASCII white-space character.
SPACE = r"[\x20\x09-\x0D]"
