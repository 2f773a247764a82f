"""Labelled seed sentences for the abuse model, built from frames and word lists by rule.

The seed gives the model a start where a corpus has few labels. It is written from general
knowledge of such language in four languages, with the innocent uses of the same words as
negatives, and holds no name or phrase of a corpus.
"""

from __future__ import annotations

from itertools import product

# Word lists.
INSULTS = {
    "en": "idiot moron imbecile fool loser scumbag bastard asshole jerk clown pig rat coward liar bitch dickhead retard maggot wanker cunt".split(),
    "de": "Idiot Trottel Arschloch Versager Schwachkopf Wichser Mistkerl Schwein Penner Hurensohn".split(),
    "fr": "imbécile crétin idiot abruti connard salaud ordure enfoiré con bouffon".split(),
    "es": "imbécil idiota cretino cabrón gilipollas payaso tarado pendejo basura mierda".split(),
}
ADJECTIVES = {
    "en": "stupid useless worthless pathetic filthy disgusting brainless ugly dumb vile".split(),
    "de": "dumm wertlos erbärmlich dreckig mies widerlich".split(),
    "fr": "sale inutile pathétique stupide misérable".split(),
    "es": "inútil estúpido asqueroso patético miserable".split(),
}
GROUPS = {
    "en": ["immigrants", "foreigners", "women", "refugees", "migrants", "gay people", "jews", "muslims", "christians", "gypsies", "disabled people", "black people", "asians", "old people"],
    "de": "Ausländer Frauen Flüchtlinge Migranten Juden Muslime Schwule Zigeuner Behinderte".split(),
    "fr": "étrangers femmes immigrés réfugiés juifs musulmans homosexuels gitans".split(),
    "es": "extranjeros mujeres inmigrantes refugiados judíos musulmanes gitanos homosexuales".split(),
}
SLURS = {
    "en": ["vermin", "parasites", "animals", "scum", "rats", "filth", "criminals", "a cancer"],
    "de": ["Ungeziefer", "Parasiten", "Abschaum", "Tiere", "Verbrecher"],
    "fr": ["vermine", "parasites", "ordures", "animaux", "criminels"],
    "es": ["escoria", "parásitos", "basura", "animales", "criminales"],
}
ABUSIVE = {
    "en": (
        "You are such a {a} {i}.", "What a {a} {i} you are.", "You {a} {i}!", "Shut your mouth, {i}.", "He is nothing more than a {a} {i}, just look at him.", "I will kill you, {i}.", "I am coming to beat you up, you {i}.",
        "You deserve to die, {i}.", "Piss off, you {a} {i}.", "Screw you, {i}.", "I will make you pay for this, {i}, count on it.", "Hang yourself, {i}.", "Your whole family is {a}, {i}.",
    ),
    "de": ("Du bist so ein {a}er {i}.", "Du {a}er {i}!", "Halt den Mund, du {i}.", "Verpiss dich, {i}.", "Ich bring dich um, du {i}.", "Fick dich, {i}."),
    "fr": ("Tu n'es qu'un {i} {a}.", "Espèce de {i}!", "Casse-toi, {i}.", "Je vais te tuer, {i}.", "Va crever, sale {i}."),
    "es": ("Eres un {i} {a}.", "Pedazo de {i}!", "Jódete, {i}.", "Te voy a matar, {i}.", "Lárgate, {i} {a}."),
}
HATEFUL = {
    "en": (
        "{g} are {v}.", "All {g} are {v} and must go.", "I despise {g}.", "{g} do not deserve to live.", "{g} should be shot.", "Get rid of all {g}.", "Kick {g} out of our country.", "{g} are inferior by nature.", "Keep our streets free of {g}.", "Kill all {g}.",
    ),
    "de": ("{g} sind {v}.", "Ich hasse alle {g}.", "{g} gehören abgeschoben.", "Tötet alle {g}.", "{g} haben hier kein Recht zu leben."),
    "fr": ("Les {g} sont des {v}.", "Je hais tous les {g}.", "Il faut chasser les {g}.", "Mort aux {g}.", "Les {g} n'ont pas le droit de vivre ici."),
    "es": ("Los {g} son {v}.", "Odio a todos los {g}.", "Hay que expulsar a los {g}.", "Muerte a los {g}.", "Los {g} no merecen vivir aquí."),
}
SEXUAL = (
    "Free porn, naked girls and sex videos.", "Hot nude women want sex with you now.", "Sexy escort ready for a night of sex.", "Send me nude pictures, I am horny.", "He kissed her naked breasts and she moaned with pleasure.", "She undressed slowly and let him inside her.",
    "They had wild sex on the bed and she screamed with lust.", "She sucked his cock and he groaned.", "Watch hardcore porn with big tits and wet pussy.", "Adult webcam with naked teens stripping.",
    "Kostenlose Pornos mit nackten Frauen.", "Geile Frauen wollen Sex mit dir.", "Er küsste ihre nackten Brüste und sie stöhnte vor Lust.", "Schick mir Nacktbilder, ich bin geil.",
    "Du porno gratuit et des femmes nues.", "Des filles chaudes veulent du sexe ce soir.", "Il embrassa ses seins nus et elle gémit de plaisir.", "Envoie-moi des photos de toi nue.",
    "Porno gratis con mujeres desnudas.", "Chicas calientes quieren sexo contigo.", "Él besó sus pechos desnudos y ella gimió de placer.", "Mándame fotos desnuda, quiero sexo.",
)
BENIGN = (
    "I was such an {i} to miss that, sorry.", "I felt like a {i} when I saw my own mistake.", "The word {i} is an insult and not allowed here.", "The rules forbid calling anybody a {i}.", "The play is about a {i} and a king.",
    "The speaker was blamed for saying that {g} are {v}.", "The law gave {g} the right to vote.", "The museum shows how {g} lived in the last century.", "A report counts {g} by year of arrival.", "The word {v} was used in the old law on pests.",
    "The process was killed after an hour.", "The stupid bug was fixed in the last release.", "The useless line was removed.", "Kill the old server before you start the new one.", "The farmer killed the rats in the barn.", "Many people died in the flood.",
    "The clinic treats breast cancer.", "Sex is a column of the table.", "Sexual health is taught in schools.", "A naked woman by a river is seen in the painting.", "The statue of a nude athlete stands in the hall.", "The study compares the sex ratio of the birds.",
    "Thank you for your help, you are very kind.", "You are right, I will change it.", "You can find more about it below.", "Please tell me what you think of it.", "I know where you found that, many thanks.", "You are welcome to add a source for that claim.", "What do you think of the new page?",
    "Ich war so ein Idiot, tut mir leid.", "Das Wort {i} ist eine Beleidigung.", "Das Bild zeigt eine nackte Frau.", "Ce mot est une insulte.", "J'ai été idiot, pardon.", "Le tableau montre une femme nue.", "Esa palabra es un insulto.", "Fui un idiota, perdón.", "El cuadro muestra una mujer desnuda.",
)

# Ordinary sentences, for the words that all sentences are made of.
ORDINARY = (
    "The house stands at the end of the street and has two floors.", "It was sold by his brother in the spring of 1904.", "Most of them came from the coast and worked on the land.", "In the same year a school was opened for the children of the workers.", "She wrote her first book when she was twenty.",
    "The team lost all of its games and was moved to a lower league.", "There are three ways to get to the lake.", "He was born in a small town and moved to the capital with his mother.", "We have changed the name of the file, so your old link will not work.", "I have added a short note to the list.",
    "If the value is empty, the next line is read.", "This table shows how often each word was used.", "They did not agree on what to do with the money.", "Nothing is known about the life of the painter.", "The train leaves at nine and gets there before noon.", "No one was hurt when the roof came down.", "It is not clear who made the first map of the island.",
    "People from all parts of the country come here in summer.", "The price went up from 3 to 5 in less than a month.", "Her work is shown in many galleries.", "You need to log in before you can save it.", "He never came back and was soon forgotten.", "What happened after that is told in another chapter.", "All of these plants grow in wet and dark places.",
    "The men took the boat and the women walked along the shore.", "That is a good idea, let me know when it is done.", "The water was warm, and the sky was clear.", "A black dog lay in front of the old door.", "Can I use this picture on my own site?", "Some of the rules should be made easier to read.", "Every page has a title and a date.", "Let us keep this short and end it here.",
    "Das Haus steht am Ende der Straße und hat zwei Stockwerke.", "Er wurde in einer kleinen Stadt geboren und zog mit seiner Mutter fort.", "In diesem Jahr wurde eine neue Schule für die Kinder gebaut.", "Die meisten von ihnen kamen von der Küste.", "Ich habe die Liste geändert, danke für den Hinweis.", "Das ist nicht mehr bekannt und wird auch nicht gebraucht.", "Du findest es auf der nächsten Seite.",
    "La maison se trouve au bout de la rue et compte deux étages.", "Il est né dans une petite ville et a grandi avec sa mère.", "Cette année-là, une école fut ouverte pour les enfants.", "La plupart venaient de la côte et travaillaient la terre.", "J'ai changé la liste, merci pour ton aide.", "On ne sait pas qui a fait la carte.", "Tu la trouveras sur la page suivante.",
    "La casa está al final de la calle y tiene dos pisos.", "Nació en un pueblo pequeño y se mudó con su madre.", "Ese año se abrió una escuela para los niños.", "La mayoría venía de la costa y trabajaba en el campo.", "He cambiado la lista, gracias por tu ayuda.", "No se sabe quién hizo el mapa.", "La encontrarás en la página siguiente.",
    "red green blue", "one two three four", "north south east west", "January February March", "u v w", "A B C D", "salt pepper sugar flour", "oak ash elm", "page 12 of 40", "see above", "done", "thanks", "name date place", "to do", "yes and no", "a", "b", "i", "the", "of the", "you", "he is", "and", "die", "der", "la", "el", "tu", "un", "una",
)


def seed() -> list[tuple[str, str]]:
    """(sentence, label) with labels abusive, hateful, sexual and ok; every frame meets every word of its lists in turn."""
    out: list[tuple[str, str]] = []
    for lang, frames in ABUSIVE.items():
        for n, (f, i) in enumerate(product(frames, INSULTS[lang])):
            out.append((f.format(a=ADJECTIVES[lang][n % len(ADJECTIVES[lang])], i=i), "abusive"))
    for lang, frames in HATEFUL.items():
        for n, (f, g) in enumerate(product(frames, GROUPS[lang])):
            s = f.format(g=g, v=SLURS[lang][n % len(SLURS[lang])])
            out.append((s[0].upper() + s[1:], "hateful"))
    out += [(s, "sexual") for s in SEXUAL for _ in range(6)]
    out += [(s, "ok") for s in ORDINARY for _ in range(8)]
    words = [i for xs in INSULTS.values() for i in xs]
    groups, slurs = [g for gs in GROUPS.values() for g in gs], SLURS["en"]
    for n, (f, k) in enumerate(product(BENIGN, range(12))):
        out.append((f.format(i=words[(5 * n + k) % len(words)], g=groups[(3 * n + k) % len(groups)], v=slurs[n % len(slurs)]), "ok"))
    return out
