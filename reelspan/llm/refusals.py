"""Examples of declining answers, from which the likelihood of a refusal is fitted."""

# Ways to decline a request to translate, a few dozen in each language; the model generalises by their letter n-grams.
DECLINING = {
    "en": (
        "I cannot translate this text.", "I can't translate that.", "I am not able to translate this content.", "I'm unable to provide a translation.", "Sorry, I can't help with that request.",
        "I'm sorry, but I cannot assist with this.", "I apologize, but I am unable to process this request.", "As an AI language model, I cannot do that.", "As an assistant I am not allowed to answer this.",
        "This content cannot be translated.", "This request can't be processed.", "The passage violates our content policy.", "It goes against the usage guidelines, so I must decline.", "I won't be able to comply with this request.",
        "Unfortunately I cannot fulfil your request.", "I must refuse to translate this passage.", "No translation can be provided for this text.", "Please provide a different text.", "I decline to answer.", "I don't feel comfortable translating this.",
        "This text is not suitable for translation.", "Sorry, I am not permitted to work with this content.",
    ),
    "zh": (
        "我无法翻译这段文字。", "我不能翻译该内容。", "很抱歉，我无法提供翻译。", "抱歉，我不能处理您的请求。", "对不起，我无法满足这个要求。", "作为人工智能语言模型，我无法回答。", "作为一个助手，我不能这样做。", "该文本违反了内容政策。",
        "这段内容不符合使用规范，无法翻译。", "此内容不适合翻译。", "我拒绝翻译这段话。", "无法完成该任务。", "暂时不能提供译文。", "恕我不能协助。", "很遗憾，我无法协助完成此请求。", "请提供其他文本。", "如需帮助，请更换内容。", "请提供更多上下文以便翻译。",
        "由于政策限制，不予翻译。", "我没有办法处理这段字幕。", "不便提供该内容的译文。", "难以满足您的请求。",
    ),
    "ru": (
        "Я не могу перевести этот текст.", "Извините, я не могу помочь с этим запросом.", "К сожалению, я не могу выполнить этот запрос.", "Этот фрагмент нельзя перевести.", "Как языковая модель, я не могу этого сделать.", "Я отказываюсь переводить это содержание.",
        "Невозможно обработать данный запрос.", "Этот текст нарушает правила использования.", "Прошу прощения, перевод недоступен.", "Я не в состоянии предоставить перевод.", "Пожалуйста, предоставьте другой текст.", "Данное содержание не подходит для перевода.", "Мне не разрешено обрабатывать этот текст.",
    ),
    "uk": (
        "Я не можу перекласти цей текст.", "Вибачте, я не можу допомогти з цим запитом.", "На жаль, я не можу виконати цей запит.", "Цей фрагмент не можна перекласти.", "Як мовна модель, я не можу цього зробити.", "Неможливо обробити цей запит.", "Цей текст порушує правила використання.",
        "Перепрошую, переклад недоступний.", "Будь ласка, надайте інший текст.",
    ),
    "de": (
        "Ich kann diesen Text nicht übersetzen.", "Es tut mir leid, ich kann bei dieser Anfrage nicht helfen.", "Leider kann ich diese Anfrage nicht bearbeiten.", "Als Sprachmodell kann ich das nicht tun.", "Dieser Inhalt darf nicht übersetzt werden.", "Ich bin nicht in der Lage, eine Übersetzung bereitzustellen.",
        "Dieser Text verstößt gegen die Richtlinien.", "Ich muss die Übersetzung dieses Inhalts ablehnen.", "Bitte geben Sie einen anderen Text an.",
    ),
    "fr": (
        "Je ne peux pas traduire ce texte.", "Désolé, je ne peux pas vous aider avec cette demande.", "Malheureusement, je ne peux pas traiter cette demande.", "En tant que modèle de langage, je ne peux pas le faire.", "Ce contenu ne peut pas être traduit.", "Je ne suis pas en mesure de fournir une traduction.",
        "Ce texte enfreint les règles d'utilisation.", "Je dois refuser de traduire ce passage.", "Veuillez fournir un autre texte.",
    ),
    "es": (
        "No puedo traducir este texto.", "Lo siento, no puedo ayudar con esa solicitud.", "Lamentablemente no puedo procesar esta solicitud.", "Como modelo de lenguaje, no puedo hacerlo.", "Este contenido no se puede traducir.", "No soy capaz de proporcionar una traducción.", "Este texto infringe las normas de uso.",
        "Debo negarme a traducir este pasaje.", "Por favor, proporcione otro texto.",
    ),
    "ja": (
        "この文章は翻訳できません。", "申し訳ありませんが、そのご要望にはお応えできません。", "この内容を処理することはできません。", "言語モデルとして、お手伝いできません。", "このテキストは利用規約に違反しています。", "翻訳を提供することができません。", "別の文章を提供してください。", "翻訳をお断りします。",
    ),
}

# What a speaker may say of themselves in like words, which is no refusal to translate.
APOLOGISING = {
    "en": ("I'm sorry, I can't come tonight.", "Sorry, I cannot help you.", "I apologize, I am unable to stay.", "Forgive me, I can't remember.", "I'm sorry, but I won't do it.", "Unfortunately I could not find it.", "Nobody answered.", "I can't do that.", "Please wait."),
    "zh": ("对不起，我帮不了你。", "抱歉，我不能来。", "很抱歉，我没有时间。", "我无法忘记那天。", "很遗憾，他没有回答。", "没人回答。", "我不能这样做。", "请等一下。", "对不起，我不知道。", "我没有办法。"),
    "ru": ("Извините, я не могу вам помочь.", "Простите, я не могу прийти.", "К сожалению, я не помню.", "Я не могу этого сделать.", "Никто не ответил.", "Пожалуйста, подождите."),
    "uk": ("Вибачте, я не можу вам допомогти.", "На жаль, я не пам'ятаю.", "Я не можу цього зробити.", "Ніхто не відповів.", "Будь ласка, зачекайте."),
    "de": ("Es tut mir leid, ich kann dir nicht helfen.", "Leider kann ich nicht kommen.", "Ich kann das nicht tun.", "Niemand hat geantwortet.", "Bitte warte."),
    "fr": ("Désolé, je ne peux pas t'aider.", "Malheureusement je ne peux pas venir.", "Je ne peux pas le faire.", "Personne n'a répondu.", "Attendez, s'il vous plaît."),
    "es": ("Lo siento, no puedo ayudarte.", "Lamentablemente no puedo venir.", "No puedo hacerlo.", "Nadie respondió.", "Por favor, espera."),
    "ja": ("申し訳ありませんが、行けません。", "ごめんなさい、手伝えません。", "覚えていません。", "それはできません。", "誰も答えませんでした。", "待ってください。"),
}
