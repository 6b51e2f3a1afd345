"""Layout of the delimited draw files and of the table `tirages` they are loaded into."""

from __future__ import annotations

NUM_BALLS, MAX_BALL, NUM_CHANCE_MAX, RANKS = 5, 49, 10, 9
BALLS = [f"boule_{i}" for i in range(1, NUM_BALLS + 1)]

#: Column name in the files -> (column of tirages, type), in the order of the table.
LAYOUT: dict[str, tuple[str, str]] = {
    "annee_numero_de_tirage": ("annee_numero", "string"),
    "jour_de_tirage": ("jour_tirage", "string"),
    "date_de_tirage": ("date_tirage", "string"),
    "date_de_forclusion": ("date_forclusion", "string"),
    **{b: (b, "int") for b in BALLS},
    "numero_chance": ("numero_chance", "int"),
    "combinaison_gagnante_en_ordre_croissant": ("combinaison_croissante", "string"),
    **{
        name: pair
        for r in range(1, RANKS + 1)
        for name, pair in (
            (f"nombre_de_gagnant_au_rang{r}", (f"gagnants_rang{r}", "bigint")),
            (f"rapport_du_rang{r}", (f"rapport_rang{r}", "double")),
        )
    },
    "nombre_de_codes_gagnants": ("nombre_codes", "bigint"),
    "rapport_codes_gagnants": ("rapport_codes", "double"),
    "codes_gagnants": ("codes_gagnants", "string"),
    "numero_jokerplus": ("numero_jokerplus", "string"),
    "devise": ("devise", "string"),
}

#: Approved renames: a field's other names, each of which stands for the field of the layout.
APPROVED: dict[str, list[str]] = {
    "date_de_forclusion": ["date_forclusion", "forclusion"],
    "numero_chance": ["num_chance", "no_chance"],
    "combinaison_gagnante_en_ordre_croissant": ["combinaison_croissante", "combinaison_gagnante"],
    "nombre_de_gagnant_au_rang5": [
        "gagnant_rg5",
        "gagnants_rang5",
        "nb_gagnants_rang_5",
        "nombre_de_gagnants_au_rang_5",
        "nombre_gagnants_rang5",
    ],
    "rapport_du_rang3": ["rapport_rang3", "gain_rang3"],
    "nombre_de_codes_gagnants": [
        "nombre_codes_gagnants",
        "nombre_de_codes",
        "nombre_codes",
        "nb_codes_gagnants",
        "nb_codes",
    ],
    "numero_jokerplus": ["num_jokerplus", "no_joker+", "numero_joker_plus", "joker_plus", "jokerplus"],
    "devise": ["code_devise", "monnaie"],
}
