"""The speakers: display name, tag in the model's vocabulary, sample texts."""

# Names, tags and texts that requests and models share.
SPEAKERS = [
    (
        '🇬🇧 👨 book reader',
        '[spkr_63]',
        [
            "Today, we'll explore the fascinating journey of ancient India, from the Indus Valley Civilization to the Mauryan Empire.",
            "Let's delve into the rich tapestry of Indian history, examining the cultural and social developments that shaped the subcontinent.",
            "Welcome to another episode on the magnificent history of India, where we'll uncover forgotten stories and legendary tales.",
        ],
    ),
    (
        '🇺🇸 👨 influencer',
        '[spkr_67]',
        [
            "What's up guys, MKBHD here with another tech review that you've been waiting for.",
            "Let's talk about the future of technology and what these changes mean for all of us.",
            'After spending two weeks with this device, here are my detailed thoughts and impressions.',
        ],
    ),
    (
        '🇮🇳 👨 book reader',
        '[spkr_68]',
        [
            "Every object has a story, and today we're uncovering the hidden history behind this remarkable find.",
            'Join me as we explore the fascinating world of vintage collectibles and their untold stories.',
            'What makes secondhand items special is not their value, but the memories they carry.',
        ],
    ),
    (
        '🇮🇳 👨 book reader',
        '[spkr_69]',
        [
            'Listen to the tale of Arjuna and Krishna, as they discuss dharma on the battlefield of Kurukshetra.',
            'Today we explore the wisdom of the Pandavas and the complex moral choices they faced.',
            'The Mahabharata teaches us about duty, honor, and the eternal struggle between right and wrong.',
        ],
    ),
    (
        '🇮🇳 👨 motivational speaker',
        '[spkr_70]',
        [
            'दोस्तों, आज हम बात करेंगे सफलता की असली कुंजी के बारे में।',
            'जीवन में सफल होने के लिए सबसे जरूरी है अपने लक्ष्य के प्रति समर्पण।',
            'याद रखिए, हर असफलता एक नई सीख लेकर आती है।',
        ],
    ),
    (
        '🇮🇳 👨 book reader heavy',
        '[spkr_62]',
        [
            'प्रेमचंद की इस अमर कहानी को सुनिए, जो आज भी उतनी ही प्रासंगिक है।',
            'आज हम पढ़ेंगे हिंदी साहित्य का एक अनमोल रत्न।',
            'इस कहानी में छिपा है जीवन का गहरा सत्य।',
        ],
    ),
    (
        '🇮🇳 👩 recipe reciter',
        '[spkr_53]',
        [
            'आज हम बनाएंगे एकदम परफेक्ट दाल मखनी, जो होटल जैसी टेस्टी बनेगी।',
            'नमस्ते दोस्तों, आज की रेसिपी है स्पेशल पनीर टिक्का मसाला।',
            'इस ट्रिक से आपकी सब्जी होटल जैसी बनेगी।',
        ],
    ),
    (
        '🇮🇳 👩 book reader',
        '[spkr_60]',
        [
            'आज की कहानी है प्रेम और त्याग की एक अनूठी गाथा।',
            'हिंदी साहित्य की इस क्लासिक रचना को सुनिए मेरी आवाज में।',
            'कहानी शुरू करने से पहले आप सभी का स्वागत है।',
        ],
    ),
    (
        '🇺🇸 👨 book reader',
        '[spkr_74]',
        [
            'Chapter One: The distant horizon stretched endlessly before us, as we embarked on our journey.',
            'In the stillness of the night, the ancient prophecy began to unfold.',
            'The characters in this story will take you on an unforgettable adventure.',
        ],
    ),
    (
        '🇮🇳 👨 entrepreneur',
        '[spkr_75]',
        [
            "Education is not just about degrees, it's about becoming a better human being.",
            'Success comes to those who are willing to push beyond their comfort zones.',
            "Today, let's discuss how to transform your dreams into achievable goals.",
        ],
    ),
    (
        '🇬🇧 👨 nature lover',
        '[spkr_76]',
        [
            'Here in the heart of the rainforest, a remarkable story of survival unfolds.',
            'These extraordinary creatures have adapted to some of the most extreme conditions on Earth.',
            "What we're witnessing is one of nature's most spectacular displays.",
        ],
    ),
    (
        '🇮🇳 👨 influencer',
        '[spkr_77]',
        [
            'दोस्तों, आज बात करेंगे कैरियर, पैसे और सफलता के बारे में।',
            'क्या आप जानते हैं कि फाइनेंशियल फ्रीडम का असली मतलब क्या है?',
            'मैंने अपनी जिंदगी में जो गलतियां की, आप उनसे सीख सकते हैं।',
        ],
    ),
    (
        '🇮🇳 👨 politician',
        '[spkr_66]',
        [
            'मेरे प्यारे देशवासियों, आज हम एक नए भारत की ओर कदम बढ़ा रहे हैं।',
            'हमारा संकल्प है - एक भारत, श्रेष्ठ भारत।',
            'युवा शक्ति ही देश की सबसे बड़ी ताकत है।',
        ],
    ),
]
