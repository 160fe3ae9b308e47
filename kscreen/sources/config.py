"""Settings of the command line: the first file that is there counts."""

from __future__ import annotations

import configparser
import os

SECTION = "kscreen"
PLACES = ("~/.kscreenrc", ".kscreenrc", "kscreen.conf", "/etc/kscreen.conf")


def settings(places: tuple[str, ...] = PLACES) -> dict[str, str]:
    """The settings of the first file that exists, by lower-case name; none without a file or section.

    store: a folder of report documents, to which every queried report is added; filters: a folder
    of filters that is screened against where none is named.
    """
    for place in places:
        path = os.path.expanduser(place)
        if os.path.isfile(path):
            found = configparser.ConfigParser(interpolation=None)
            found.read(path)
            return {k: v.strip() for k, v in found.items(SECTION)} if found.has_section(SECTION) else {}
    return {}
