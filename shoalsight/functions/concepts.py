"""Concept tables for prototype scoring: fixed values, one line per concept (key, phrase, label, tags)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Fixed values.
PROMPTS = ("a photo of {}", "a photograph showing {}", "an event photo of {}", "a candid image of {}")

# Fixed values.
ACTIONS = """
portrait_pose | people posing for a portrait | Portrait | portrait posed
solo_walk | a person walking | Walking | walking solo movement
group_walk | people walking together | Walking Together | walking group movement
speech | someone giving a speech | Speech | speech speaker main_action
speech_audience | people listening to a speech | Audience Listening | audience speech reaction
applause | people applauding | Guests Applauding | applause reaction audience
dance | people dancing | Dancing | dance movement group
couple_dance | a couple dancing | Couple Dancing | dance couple main_action
hug | people hugging | Hugging | hug interaction main_action
kiss | people kissing | Kissing | kiss interaction main_action
rings | people exchanging rings | Ring Exchange | rings ceremony interaction main_action
cake_cutting | people cutting a cake | Cake Cutting | cake interaction main_action
eating | people eating | Eating | eating group
makeup | someone applying makeup | Makeup | makeup preparation interaction
dressing | someone getting dressed | Getting Dressed | dressing preparation
flowers | someone holding flowers | Holding Flowers | flowers portrait
sitting | people sitting together | Seated Group | sitting group
standing | people standing together | Standing Group | standing group posed
laughing | people laughing | Laughing | laughing reaction
talking | people talking | Talking | talking interaction
procession | a procession | Procession | procession movement ceremony
group_portrait | a group portrait | Group Portrait | portrait group posed
couple_portrait | a couple portrait | Couple Portrait | portrait couple posed
solo_portrait | a solo portrait | Solo Portrait | portrait solo posed
candid_interaction | a candid interaction | Candid Interaction | candid interaction
children_playing | children playing | Children Playing | play movement group
entering_room | people entering a room | Entering | entering movement
leaving_room | people leaving | Leaving | leaving movement
aisle_walk | a bride walking down the aisle | Bride Walking Down The Aisle | aisle walking ceremony main_action
altar_waiting | a groom waiting at the altar | Groom Waiting At The Altar | altar ceremony portrait
wedding_ring_exchange | a wedding ring exchange | Ring Exchange | rings ceremony interaction main_action wedding
wedding_first_kiss | a wedding first kiss | First Kiss | kiss ceremony interaction main_action wedding
ceremony_reading | a wedding ceremony reading | Ceremony Reading | ceremony speech main_action wedding
wedding_speech | a wedding speech | Wedding Speech | speech speaker main_action wedding
wedding_toast | a wedding toast | Wedding Toast | speech toast main_action wedding
wedding_cake_cutting | a wedding cake cutting | Cake Cutting | cake interaction main_action wedding
bouquet_toss | a wedding bouquet toss | Bouquet Toss | bouquet movement main_action wedding
first_dance | a wedding first dance | First Dance | dance couple main_action wedding
bride_makeup | a bride getting makeup applied | Bride Makeup | makeup preparation interaction wedding
bride_dress | a bride putting on a wedding dress | Bride Dressing | dressing preparation wedding
bridesmaids_pose | a bride posing with bridesmaids | Bride With Bridesmaids | portrait group posed wedding
groomsmen_pose | a groom posing with groomsmen | Groom With Groomsmen | portrait group posed wedding
family_wedding_portrait | a family wedding portrait | Family Portrait | portrait family group posed wedding
wedding_couple_portrait | a wedding couple portrait | Couple Portrait | portrait couple posed wedding
wedding_guests_applauding | wedding guests applauding | Guests Applauding | applause reaction audience wedding
wedding_guests_dancing | wedding guests dancing | Dance Floor | dance group wedding
"""

# Fixed values.
SCENES = """
indoor_ceremony | an indoor ceremony | Indoor Ceremony | ceremony indoor
outdoor_ceremony | an outdoor ceremony | Outdoor Ceremony | ceremony outdoor
dance_floor | a dance floor | Dance Floor | dance venue
reception_hall | a reception hall | Reception Hall | reception venue
church_interior | a church interior | Church Interior | church venue
beach | a beach | Beach | beach outdoor
forest | a forest | Forest | forest outdoor
garden | a garden | Garden | garden outdoor
city_street | a city street | City Street | street outdoor
hotel_room | a hotel room | Hotel Room | room indoor
dressing_room | a dressing room | Dressing Room | dressing_room indoor
dining_table | a dining table | Dining Table | table indoor
stage | a stage | Stage | stage venue
sunset_field | a sunset field | Sunset Field | field outdoor sunset
dark_indoor | a dark indoor venue | Dark Indoor Venue | indoor dark
bright_outdoor | a bright outdoor location | Bright Outdoor Location | outdoor bright
"""

# Fixed values.
SHOTS = """
close_up_portrait | a close-up portrait | Close-up Portrait | close_up portrait
medium_portrait | a medium portrait | Medium Portrait | medium portrait
full_body_portrait | a full-body portrait | Full-body Portrait | full_body portrait
wide_environmental_portrait | a wide environmental portrait | Wide Environmental Portrait | wide portrait
group_portrait_shot | a group portrait | Group Portrait | group portrait
candid_shot | a candid photograph | Candid | candid
detail_shot | a detail photograph | Detail | detail
reaction_shot | a reaction photograph | Reaction | reaction
audience_shot | an audience photograph | Audience | audience
main_action_shot | a photograph of the main action | Main Action | main_action
"""

# Families in the order that decides between several tags.
FAMILIES = "rings kiss speech toast applause audience dance cake makeup dressing portrait walking procession hug talking laughing eating flowers bouquet play entering leaving".split()
SHOT_MODES = ("main_action", "reaction", "audience", "detail", "portrait", "candid")


@dataclass(frozen=True)
class Concept:
    key: str
    phrase: str
    label: str
    tags: tuple[str, ...]

    @property
    def family(self) -> str:
        """The first family, in the fixed order, among the tags; else the first tag."""
        return next((f for f in FAMILIES if f in self.tags), self.tags[0] if self.tags else "generic")

    @property
    def shot_mode(self) -> str:
        return next((m for m in SHOT_MODES if m in self.tags), "main_action")


def parse(table: str) -> tuple[Concept, ...]:
    rows = (map(str.strip, line.split("|")) for line in table.strip().splitlines())
    return tuple(Concept(key, phrase, label, tuple(tags.split())) for key, phrase, label, tags in rows)


CONCEPTS = {"action": parse(ACTIONS), "scene": parse(SCENES), "shot": parse(SHOTS)}


def concept_table(spark: SparkSession) -> DataFrame:
    """category, ord, key, phrase, label, tags, family."""
    rows = [(c, i, x.key, x.phrase, x.label, list(x.tags), x.family) for c, xs in CONCEPTS.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "category string, ord int, key string, phrase string, label string, tags array<string>, family string")
