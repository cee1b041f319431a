"""Function words of the languages that the tables hold."""

# Frequent function words, one list per language; words in two lists vote for both.
STOPWORDS = {
    "en": "the of and that to was with for by not a in is are this from which no at it has be been were on an as but so had his her they their would",
    "de": "der die das und ist nicht ein eine dem den des von mit sich auf für im in zu dass wurde bei nach über nur keine aus sie er als auch es an einen daher deshalb damit",
    "fr": "le la les de des que et est un une du dans pour qui sur par au ne pas ce cette son avec aux il elle donc après été même sans se en ainsi",
    "es": "el la los las de que y es un una del en por con no se su al lo para como más este esta fue había según sobre sin pero así durante",
    "pt": "o a os as de que e é um uma do da em por com não se seu ao no na para como mais este esta foi havia segundo sobre sem dos das pelo mas assim durante",
    "ru": "и в не на что с по как это из за для от о к был была было его её но же так тем самым поэтому которую без у а то тот",
}
