"""A keyword dictionary for instrument categories and rule sets built on it: plain data of our own, to be replaced at will."""

from __future__ import annotations

_WORDS = {
    "Drums": "kick, snare, tom, hat, cymbal, clap, drum",
    "Percussion": "shaker, conga, bongo, tambourine, cowbell, triangle",
    "Bass": "bass, sub, low end",
    "Guitar": "guitar, strum, riff, banjo",
    "Keys": "piano, organ, rhodes, clavinet, harpsichord",
    "Synth": "synth, lead synth, arp, pad",
    "Strings": "string, violin, viola, cello, harp",
    "Brass": "brass, trumpet, trombone, tuba, horn",
    "Woodwind": "flute, clarinet, oboe, bassoon, saxophone",
    "Vocals": "vocal, vox, choir, backing vocal, ad lib",
    "Effects": "riser, sweep, impact, noise, fx",
}
CATEGORIES = [{"name": name, "keywords": words, "affix": f"{name.upper()} - "} for name, words in _WORDS.items()]

_CLEAN = [{"kind": "op", "op": op} for op in ("stripLeadingDashes", "stripLeadingNumberPrefix", "collapseWhitespace", "trim")]
#: Names of a song's stems: cleaned, then led by their category.
DEFAULT_RULES = [*_CLEAN, {"kind": "op", "op": "categoryBundle", "params": {"categories": CATEGORIES}}]
#: Names of a sample pack: cleaned, numbers of two digits at the end, capitals, then led by their category.
PACK_RULES = [
    *_CLEAN, {"kind": "op", "op": "padNumericSuffix"}, {"kind": "op", "op": "titleCase"},
    {"kind": "op", "op": "categoryBundle", "params": {"categories": CATEGORIES}},
]
