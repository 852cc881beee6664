"""Integer codes of the three acoustic label columns."""

# Family, genus and species codes, each in alphabetical order.
FAMILY_CODES = {"Bufonidae": 0, "Dendrobatidae": 1, "Hylidae": 2, "Leptodactylidae": 3}
GENUS_CODES = {
    "Adenomera": 0, "Ameerega": 1, "Dendropsophus": 2, "Hypsiboas": 3, "Leptodactylus": 4, "Osteocephalus": 5,
    "Rhinella": 6, "Scinax": 7,
}
SPECIES_CODES = {
    "AdenomeraAndre": 0, "AdenomeraHylaedactylus": 1, "Ameeregatrivittata": 2, "HylaMinuta": 3,
    "HypsiboasCinerascens": 4, "HypsiboasCordobae": 5, "LeptodactylusFuscus": 6, "OsteocephalusOophagus": 7,
    "Rhinellagranulosa": 8, "ScinaxRuber": 9,
}
