"""The vocabulary of the portal in the test data, passed to the operators as parameters."""

from __future__ import annotations

from ..functions import rules as rl
from ..operators import entities as en

SLUGS = ("orvex-2", "selkara-1", "nimbra-3", "thalvos-4", "ventira-1", "mariste-3", "cirrane-2", "brumalis-1", "zephrin-2", "ombrela-2", "glavis-3", "fendris-1", "korune-1a", "lumexa-5", "pluvane-2", "tidora-1", "haldora-1", "aquenta-1b")
#: Slugs in urls that stand for another mission's.
STANDS_FOR = (("orvex2", "orvex-2"), ("korune-1", "korune-1a"), ("aquenta-1", "aquenta-1b"))
MISSIONS: rl.Rules = tuple((s, (s, s.replace("-", ""))) for s in SLUGS)
INSTRUMENTS = ("sounder", "mapper", "photometer", "polarimeter", "interferometer", "scatterometer", "altimeter", "radiometer", "imager", "lidar", "radar", "spectrometer", "profiler", "counter", "camera", "detector", "scanner")

PAGES = en.PageRules(
    faq=("frequently asked", "your questions", "questions and answers"),
    slugs=(*((s, s) for s in SLUGS), *STANDS_FOR),
    sections=("introduction", "objectives", "spacecraft", "payloads", "references"),
    open_data=("opendata", "open-data", "monthly-means", "browse-images", "orbit-files"),
    kinds=(
        ("mission", ("was launched", "twice a day at an altitude", "the mission office")),
        ("product", ("granule", "netcdf", "geotiff", "grib", "bufr", "level-")),
        ("document", ("handbook", "user guide", "station reports", "product manuals")),
        ("geospatial", ("stations in", "swath", "grid spans")),
    ),
)
SECTIONS: rl.Rules = (("introduction", ("introduction", "about")), ("objective", ("objective",)), ("spacecraft", ("spacecraft",)), ("payload", ("payload", "instrument")), ("reference", ("reference", "reading")))
PRODUCTS = en.ProductRules(
    categories=(("Ocean", ("ocean", "wave", "salinity", "tide")), ("Atmosphere", ("wind", "cloud", "rain", "ozone")), ("Land", ("soil", "snow", "vegetation"))),
    coverages=("tessaly shelf", "kaspen archipelago", "uskar desert", "norvane sea", "gulf of ostmira"),
    algorithms=("gridded field", "cloud screen", "cross-calibrat", "bias estimate"),
    labels=(("orvex-2-introduction", "ORVEX-2 at a glance"),),
    downloads="https://portal.samverta.example/help/",
)
QUESTIONS: rl.Rules = (
    ("product", ("which format", "older than", "free of charge", "granules")),
    ("faq", ("how can i", "do i need", "where do i report", "why did my order", "can i order")),
    ("document", ("handbook", "user guide", "quality flag")),
    ("payload", ("how accurate", *INSTRUMENTS)),
    ("mission", ("launched", "orbit", *SLUGS)),
)
#: (mission, kind of orbit, family, agency)
DIMENSION = tuple((s, ("Polar", "Equatorial", "Inclined")[i % 3], s.split("-")[0].upper(), "Samverta Data Centre") for i, s in enumerate(SLUGS[:15]))
