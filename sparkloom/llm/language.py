"""Which language a text is written in: letter n-grams of short samples, scored with a margin.

The model is trained here, when the module is loaded, on the samples below: for each language the
logarithms of the smoothed shares of the n-grams of its padded words. Scripts of their own decide
before any n-gram does.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

#: Samples of plain prose, by language.
SAMPLES = {
    "en": "The value that we are looking for is found in the last step. First all products of the row were written down, then the sum was taken and checked once more. So the determinant of this matrix is the result of the exercise, which follows from the rows and columns. "
    "Please find, compute, calculate or evaluate the rank, the trace, the norm and the transpose. What does one get for it? The matrix is invertible, its columns are independent, and the rank is maximal overall. Nothing needs rounding until the very end. Every sign stays, I have been there before, you can see how they will turn out. "
    "need can could would should help with show your work explain briefly given let where when what how much many other only some any each same such than about into over after between both under again more most read left right top bottom corner diagonal entries expanding swapping changed keeps small second pass gives figure calculation leaves comes to equals putting pieces together det tr let take write work out at hand as follows start from on the board here is a small exercise",
    "de": "Der Wert, den wir suchen, ergibt sich im letzten Schritt. Zuerst wurden alle Produkte der Zeile notiert, dann wurde die Summe gebildet und noch einmal geprüft. Damit ist die Determinante dieser Matrix das Ergebnis der Aufgabe, das aus den Zeilen und Spalten folgt. "
    "Bitte berechne, bestimme oder finde den Rang, die Spur, die Norm und die Transponierte. Gerundet wird erst ganz am Schluss der Rechnung. Die Vorzeichen habe ich auch gesehen, wir erhalten also genau das, was man nicht mehr braucht. "
    "und oder aber nicht kein eine einen einem einer eines auf aus bei mit nach von zu zum zur über unter durch für gegen ohne um wenn weil dass wie was wer wo ist sind war waren wird werden wurde hat haben kann können muss müssen soll man sich ich du er sie es wir ihr noch schon nur sehr so dann hier dort übrig bleibt lautet gesuchte zweite bestätigt fertig sei gegeben",
    "fr": "La valeur que nous cherchons se trouve à la dernière étape. Les produits de la ligne ont d'abord été notés, puis la somme a été faite et vérifiée encore une fois. On obtient donc le déterminant de cette matrice comme résultat de l'exercice, qui vient des lignes et des colonnes. "
    "Calcule, trouve ou détermine le rang, la trace, la norme et la transposée. On arrondit seulement à la toute fin du calcul. J'ai vu les signes, il reste ce qui suit, et c'est ainsi que nous avons fini. "
    "et ou mais ne pas plus aucun une un le la les des du de au aux ce cette ces son sa ses leur dans sur sous avec sans pour par entre vers chez qui que quoi dont où quand comme si est sont était été sera ont avait peut doit faut on il elle nous vous ils elles je tu encore toujours très aussi alors ainsi ici vaut reste cherchée passage confirme soit donnée",
    "es": "El valor que buscamos se encuentra en el último paso. Primero se anotaron los productos de la fila, luego se hizo la suma y se ha revisado otra vez. Por lo tanto, el determinante de esta matriz es el resultado del ejercicio, que sale de las filas y las columnas. "
    "Calcula, halla o encuentra el rango, la traza, la norma y la traspuesta. Solo se redondea al final de toda la cuenta. He visto los signos, nos queda lo que sigue y con esto hemos terminado. "
    "y o pero no ni una un el la los las del de al este esta estos estas su sus en sobre con sin para por entre hacia desde que quien donde cuando como si es son era fue será han había puede debe hay se lo le nos ella ellos yo tú todavía siempre muy también entonces así aquí vale queda pedido respuesta obtiene segunda pasada confirma sea dada",
    "it": "Il valore che cerchiamo si trova nell'ultimo passaggio. Prima sono stati scritti i prodotti della riga, poi è stata fatta la somma e ho controllato ancora una volta. Si ottiene dunque il determinante di questa matrice come risultato dell'esercizio, che viene dalle righe e dalle colonne. "
    "Calcola o trova il rango, la traccia, la norma e la trasposta. Si arrotonda soltanto alla fine del calcolo. Ho visto i segni, rimane quello che segue e così abbiamo finito. "
    "e o ma non né una uno un il lo la i gli le del dello della dei degli delle al alla nel nella sul sulla con senza per tra fra da che chi dove quando come se è sono era stato sarà hanno aveva può deve si ci lui lei noi voi loro io tu ancora sempre molto anche allora così qui vale quindi dopo minori finale conferma sia data",
    "nl": "De waarde die we zoeken, vinden we in de laatste stap. Eerst zijn alle producten van de rij opgeschreven, daarna is de som genomen en nog eens nagekeken. Dus is de determinant van deze matrix het antwoord op de opgave, dat uit de rijen en kolommen volgt. "
    "Bereken of bepaal de rang, het spoor, de norm en de getransponeerde. Er wordt pas helemaal aan het eind afgerond. Ik heb de tekens gezien, er blijft over wat volgt en zo zijn we klaar. "
    "en of maar niet geen een het de op uit bij met na van naar te tot over onder door voor tegen zonder om als omdat dat hoe wat wie waar is zijn was waren wordt worden heeft hebben kan kunnen moet moeten zal men zich ik jij hij zij wij jullie nog al alleen zeer ook dan hier daar gevraagde uiteindelijk berekening gegeven",
    "pt": "O valor que procuramos encontra-se no último passo. Primeiro foram anotados os produtos da linha, depois foi feita a soma e conferi mais uma vez. Assim obtemos o determinante desta matriz como resultado do exercício, que vem das linhas e das colunas. "
    "Calcule ou encontre o posto, o traço, a norma e a transposta. Só se arredonda no fim de toda a conta. Vi os sinais, fica apenas o que segue e então terminamos. "
    "e ou mas não nem uma um o a os as do da dos das ao à no na nos nas este esta seu sua com sem para por entre até que quem onde quando como se é são era foi será têm havia pode deve há lhe nós você eles elas eu tu ainda sempre muito também então aqui vale última menores final segunda passagem confirma seja dada",
    "pl": "Szukany wynik znajdujemy w ostatnim kroku. Najpierw zapisano iloczyny z wiersza, potem wzięto sumę i jeszcze raz sprawdziłem. Zatem wyznacznik tej macierzy jest odpowiedzią na zadanie, która wynika z wierszy i kolumn. "
    "Oblicz lub znajdź rząd, ślad, normę i transpozycję. Zaokrąglamy dopiero na samym końcu rachunku. Widziałem znaki, zostaje nam to, co dalej, i ostatecznie otrzymujemy to jako odpowiedź. "
    "i lub ale nie żaden jest są był była było będzie w we z ze na po do od dla przez przy bez nad pod między że który która które kto co gdzie kiedy jak jeśli to ten ta te się ja ty on ona my wy oni jeszcze już tylko bardzo także więc tu tam minorów ostatnim niech dana",
    "tr": "Aradığımız değer son adımda bulunur. Önce satırdaki çarpımlar yazıldı, sonra toplam alındı ve bir kez daha kontrol ettim. Böylece bu matrisin determinantı sorunun cevabı olarak elde edilir; satır ve sütunlardan çıkar. "
    "Rangı, izi, normu ve devriği hesapla ya da bul. Yuvarlama yalnızca hesabın en sonunda yapılır. İşaretleri gördüm, son işlemden sonra geriye bu kalır, sonuç bu durumda böyle olur. "
    "ve veya ama değil yok bir bu şu o için ile gibi kadar göre sonra önce üzerinde altında arasında ki ne kim nerede nasıl eğer var idi olan olarak oldu olur edildi eder ben sen biz siz onlar daha çok sadece da de burada orada minörlerin verilen",
    "sv": "Värdet som vi söker finns i det sista steget. Först skrevs alla produkter i raden upp, sedan togs summan och kontrollerades en gång till. Alltså är determinanten för denna matris svaret på uppgiften, som följer av rader och kolonner. Beräkna eller bestäm rangen, spåret och normen. "
    "och eller men inte ingen ett en den det de på ur vid med efter av till över under genom för mot utan om när att hur vad vem var är vara blir har kan måste skall man sig jag du han hon vi ni ännu redan bara mycket också här där givet avrundas först slutet",
    "da": "Værdien som vi søger findes i det sidste skridt. Først blev alle produkter i rækken skrevet op, så blev summen taget og kontrolleret en gang til. Altså er determinanten af denne matrix svaret på opgaven, som følger af rækker og søjler. Beregn eller bestem rangen, sporet og normen. "
    "og eller men ikke ingen et en den det de på ud ved med efter af til over under gennem for mod uden om når at hvordan hvad hvem hvor er være bliver har kan skal man sig jeg du han hun vi endnu allerede kun meget også her der givet afrundes slutningen",
    "cs": "Hledanou hodnotu najdeme v posledním kroku. Nejprve byly zapsány součiny z řádku, potom byl vzat součet a ještě jednou zkontrolován. Determinant této matice je tedy odpovědí na úlohu, která plyne z řádků a sloupců. Spočítej nebo najdi hodnost, stopu a normu. "
    "a nebo ale ne žádný je jsou byl byla bylo bude v ve z ze na po do od pro přes při bez nad pod mezi že který která které kdo co kde kdy jak jestli to ten ta se já ty on ona my vy oni ještě už jen velmi také proto tady tam zaokrouhluje konci výsledek",
    "ro": "Valoarea pe care o căutăm se află la ultimul pas. Mai întâi au fost scrise produsele din linie, apoi s-a făcut suma și a fost verificată încă o dată. Prin urmare, determinantul acestei matrice este răspunsul la exercițiu, care rezultă din linii și coloane. Calculează sau află rangul, urma și norma. "
    "și sau dar nu nici un o unei unui la din pe cu fără pentru prin între spre care cine unde când cum dacă este sunt era fost va au poate trebuie se îl noi voi ei ele eu tu încă mereu foarte doar aici acolo rotunjește sfârșitul",
    "hu": "A keresett értéket az utolsó lépésben találjuk. Először felírtuk a sor szorzatait, azután vettük az összeget, és még egyszer ellenőriztem. Tehát ennek a mátrixnak a determinánsa a feladat eredménye, amely a sorokból és oszlopokból következik. Számítsd ki a rangot, a nyomot és a normát. "
    "és vagy de nem nincs egy az ez ezt hogy ami aki ahol mikor hogyan ha van volt lesz meg el ki be fel le össze mert csak nagyon is itt ott kerekítünk végén",
    "fi": "Etsimämme arvo löytyy viimeisestä vaiheesta. Ensin kirjoitettiin rivin tulot, sitten otettiin summa ja tarkistin sen vielä kerran. Siis tämän matriisin determinantti on tehtävän vastaus, joka seuraa riveistä ja sarakkeista. Laske tai etsi aste, jälki ja normi. "
    "ja tai mutta ei yksi se tämä joka mikä kuka missä milloin miten jos on ovat oli olivat olla kuin vain hyvin myös täällä siellä pyöristetään lopussa",
}
#: Scripts that belong to languages without samples.
SCRIPTS = (("ru", r"[Ѐ-ӿ]"), ("zh", r"[一-鿿぀-ヿ]"), ("ko", r"[가-힯]"), ("ar", r"[؀-ۿ]"), ("el", r"[Ͱ-Ͽ]"), ("he", r"[֐-׿]"), ("hi", r"[ऀ-ॿ]"), ("th", r"[฀-๿]"))
SCRIPTS = tuple((name, re.compile(pattern)) for name, pattern in SCRIPTS)
WORD, ENDS = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?]\s+|\n")
#: Longest n-gram, smoothing, and by how much another language must be likelier: in all, and for each word.
LONGEST, SMOOTHING, MARGIN, MARGIN_PER_WORD = 4, 0.5, 6.0, 0.6


def ngrams(word: str) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for n in range(2, LONGEST + 1) for i in range(len(padded) - n + 1)] + [padded]


def _train() -> dict[str, tuple[dict[str, float], float]]:
    counts = {lang: Counter(g for w in WORD.findall(text.lower()) for g in ngrams(w)) for lang, text in SAMPLES.items()}
    size = len(set().union(*counts.values()))
    out = {}
    for lang, c in counts.items():
        total = math.log(sum(c.values()) + SMOOTHING * size)
        out[lang] = {g: math.log(n + SMOOTHING) - total for g, n in c.items()}, math.log(SMOOTHING) - total
    return out


MODEL = _train()


@lru_cache(maxsize=50_000)
def word_scores(word: str) -> tuple[float, ...]:
    """Log likelihood of a word per language of SAMPLES, by the mean over its n-grams, so that long words don't count more."""
    grams = ngrams(word)
    return tuple(sum(held.get(g, unseen) for g in grams) / len(grams) * 4 for held, unseen in MODEL.values())


def scores(text: str) -> dict[str, float]:
    """Log likelihood of a text's words per language, sentence by sentence, as these repeat."""
    totals = [0.0] * len(MODEL)
    for part in ENDS.split(text.lower()):
        if words := [w for w in WORD.findall(part) if len(w) > 1]:
            totals = [a + b for a, b in zip(totals, _sentence_scores(" ".join(words)))]
    return dict(zip(MODEL, totals))


def script(text: str) -> str | None:
    """The language of a script of its own that holds much of a text's letters."""
    if text.isascii():
        return None
    letters = sum(ch.isalpha() for ch in text)
    return next((name for name, pattern in SCRIPTS if len(pattern.findall(text)) > 0.3 * letters), None)


@lru_cache(maxsize=50_000)
def _sentence_scores(words: str) -> tuple[float, ...]:
    totals = [0.0] * len(MODEL)
    for w in words.split():
        totals = [a + b for a, b in zip(totals, word_scores(w))]
    return tuple(totals)


def likely(text: str) -> set[str]:
    """The languages a text may be written in: its script's, or all within half the margin of the likeliest; none without words."""
    if own := script(text):
        return {own}
    found = scores(text)
    best = max(found.values())
    return {lang for lang, n in found.items() if n >= best - MARGIN / 2} if best else set()


def differs(prompt: str, text: str) -> bool:
    """Whether a text is written in another language than the prompt may be, by a clear margin. Ties count for the prompt's."""
    asked = likely(prompt)
    if not asked:
        return False
    if own := script(text):
        return own not in asked
    words = [w for w in WORD.findall(text) if len(w) > 1]
    found, own = scores(text), [lang for lang in asked if lang in MODEL]
    if not own or not words:  # a prompt in a script of its own
        return len(words) > 1
    lead = max(found.values()) - max(found[lang] for lang in own)
    return lead >= max(MARGIN, MARGIN_PER_WORD * len(words))
